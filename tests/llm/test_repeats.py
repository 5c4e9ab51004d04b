import numpy as np

from voxelmetry.llm import quality as Q


def test_repeats_alone_are_rejected_beside_clean_documents(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghijkl"), rng.integers(3, 8)))
    sizes = lambda n: np.exp(rng.normal(5, 0.5, n)).clip(60).astype(int)
    prose = lambda n: [word() for _ in range(n)]
    clean = [" ".join(prose(n)) + "\n" + "\n".join(" ".join(prose(5)) for _ in range(6)) for n in sizes(300)]
    # short equal lines beside a paragraph, and a passage said again; each is ordinary in the other statistics
    lines = [" ".join(prose(n)) + "\nok go" * 9 for n in sizes(20)]
    words = []
    for n in sizes(20):
        said = prose(int(n) // 4)
        words.append(" ".join(said + prose(int(n) // 2 + 12) + said))
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(clean + lines + words)], "doc_id BIGINT, text STRING, lang STRING, source STRING")
    got = {r.doc_id: r for r in Q.robust_outliers(df).collect()}
    assert not any(got[i].base_failed for i in range(340))
    assert sum(got[i].kept for i in range(300)) >= 297
    assert not any(got[i].kept for i in range(300, 320)) and not any(got[i].kept for i in range(320, 340))
