"""Stand-in views over the given tables: voxels, patch points, artifact names, records.

Each view is one SQL text that both Spark and the checking database can run; ``{name}`` refers to another
table or view. They bring the given star schema into the shape the operators take (see FIXTURES.md).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

_VIEWS = {
    # a bag of scored voxels: probability, label class, scan value, population flag
    "scored": """
        SELECT l_suppkey AS volume_id, l_quantity / 50 AS p,
               CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS label,
               CAST(floor(l_extendedprice) AS INT) % 256 AS ct, n_regionkey = 0 AS located
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey""",
    # sparse volumes on a 7 x 8 x 8 grid, one per supplier, so their number grows with the data
    "vox": """
        SELECT vol, z, y, x, k, CASE WHEN k % 9 = 0 THEN 0 ELSE ct END AS ct,
               CASE WHEN k % 10 < 3 THEN 1 WHEN k % 10 < 6 THEN 2 ELSE 0 END AS label,
               k % 7 < 3 AS pred, CAST(k % 101 AS DOUBLE) / 101 AS p,
               (CAST(k % 13 AS DOUBLE) - 6) / 2 AS l0, (CAST(k % 17 AS DOUBLE) - 8) / 2 AS l1
        FROM (SELECT l_suppkey AS vol, l_linenumber - 1 AS z, CAST(l_partkey % 8 AS INT) AS y,
                     CAST(l_orderkey % 8 AS INT) AS x, CAST(5 * max(l_quantity) AS INT) AS ct,
                     CAST(sum(l_partkey) + sum(l_orderkey) AS BIGINT) AS k
              FROM {lineitem}
              GROUP BY l_suppkey, l_linenumber - 1, CAST(l_partkey % 8 AS INT), CAST(l_orderkey % 8 AS INT)) AS g""",
    # patch points as a 7 x 3 node grid; about 50 patches share a slab at every scale
    "pts": """
        SELECT patch, slab, bad, i, CAST(floor(i / 3) AS INT) AS row, i % 3 AS col, x, y, z
        FROM (SELECT vec_id AS patch, label + 10 * CAST(floor(vec_id / 500) AS INT) AS slab,
                     vec_id % 6 = 0 AS bad, i, CAST(embedding[3 * i + ORIGIN] AS DOUBLE) * 200 AS x,
                     CAST(embedding[3 * i + 1 + ORIGIN] AS DOUBLE) * 200 AS y,
                     CAST(embedding[3 * i + 2 + ORIGIN] AS DOUBLE) * 200 AS z
              FROM (SELECT vec_id, label, embedding, UNNEST_21 AS i FROM {embeddings}) AS e) AS t""",
    # published artifacts: one name per order
    "runs": """
        SELECT o_orderkey AS run_no, o_custkey AS cust, concat('Scroll', CAST(o_custkey AS STRING)) AS scroll,
               CASE WHEN o_orderkey % 11 = 0 THEN concat('notes-', CAST(o_orderkey AS STRING)) ELSE
                 concat(CAST(20230101000000 + (o_custkey % 28) * 1000000 + (o_custkey % 24) * 10000 AS STRING),
                        '-surface-', CAST(20240101000000 + (o_orderkey % 28) * 1000000 + CAST(floor(o_orderkey / 28) AS BIGINT) % 24 * 10000
                                                                         + CAST(floor(o_orderkey / 672) AS BIGINT) % 60 * 100 + CAST(floor(o_orderkey / 40320) AS BIGINT) % 60 AS STRING), '-',
                        CASE o_orderkey % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'base-tta' ELSE 'wide-2um-ps256' END,
                        '-L', CAST(o_orderkey % 2 + o_orderkey % 3 AS STRING), '-th',
                        CASE o_orderstatus WHEN 'F' THEN '0.2' WHEN 'O' THEN '0.35' ELSE '0.5' END, '.zarr') END AS name,
               CAST(floor((1024 + 64 * (o_custkey % 5)) / power(2, pl)) AS INT) AS pz,
               CAST(floor((2048 + 64 * (o_custkey % 5)) / power(2, pl)) AS INT) AS py,
               CAST(floor((3072 + 64 * (o_custkey % 5)) / power(2, pl)) AS INT) AS px,
               o_totalprice / 600000 AS dice
        FROM (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 9 WHEN o_orderkey % 5 = 0 THEN 0
                             ELSE o_orderkey % 2 + o_orderkey % 3 END AS pl FROM {orders}) AS o""",
    # scan pyramids: levels 0-4 per customer, some without a scan and some with a missing level; every fourth has a second
    # scan of half the size, whose levels have the shapes of other levels of the first
    "cts": """
        SELECT c_custkey AS cust, concat('Scroll', CAST(c_custkey AS STRING)) AS scroll,
               concat(CAST(20230101000000 + (c_custkey % 28) * 1000000 + (c_custkey % 24) * 10000 AS STRING),
                      '-', CAST(CASE c_custkey % 3 WHEN 0 THEN 2.4 WHEN 1 THEN 7.91 ELSE 9.36 END AS STRING), 'um-77keV.zarr') AS ct_volume,
               level,
               CAST(floor((1024 + 64 * (c_custkey % 5)) / power(2, level)) AS INT) AS cz,
               CAST(floor((2048 + 64 * (c_custkey % 5)) / power(2, level)) AS INT) AS cy,
               CAST(floor((3072 + 64 * (c_custkey % 5)) / power(2, level)) AS INT) AS cx
        FROM (SELECT c_custkey, UNNEST_5 AS level FROM {customer}) AS c
        WHERE c_custkey % 13 <> 0 AND NOT (c_custkey % 17 = 0 AND level = 2)
        UNION ALL
        SELECT c_custkey, concat('Scroll', CAST(c_custkey AS STRING)), concat(CAST(20250101000000 + c_custkey % 28 * 1000000 AS STRING), '-4.7um-110keV.zarr'), level,
               CAST(floor((1024 + 64 * (c_custkey % 5)) / power(2, level + 1)) AS INT), CAST(floor((2048 + 64 * (c_custkey % 5)) / power(2, level + 1)) AS INT),
               CAST(floor((3072 + 64 * (c_custkey % 5)) / power(2, level + 1)) AS INT)
        FROM (SELECT c_custkey, UNNEST_5 AS level FROM {customer}) AS c2
        WHERE c_custkey % 4 = 0""",
    "docs": """
        SELECT doc_id, source, lang, n_chars, text, length(trim(text)) AS content_chars FROM {documents}""",
    # per-document measurements with a binary outcome, grouped by source
    "feat": """
        SELECT d.doc_id AS item, CAST(substr(source, 4) AS INT) AS slab, CAST(quality = 0 AS INT) AS y,
               CAST(n_chars AS DOUBLE) AS n_chars, CAST(length(replace(text, ' ', '')) AS DOUBLE) / greatest(n_chars, 1) AS dense,
               CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) / greatest(n_chars, 1) AS vowel,
               CAST(length(text) - length(replace(text, '.', '')) AS DOUBLE) / greatest(n_chars, 1) AS stops
        FROM {documents} AS d JOIN {labels} AS l ON d.doc_id = l.doc_id""",
    "log": "SELECT l_orderkey AS request, l_partkey AS chunk, l_linenumber AS part FROM {lineitem}",
    # metric records: one per event
    "records": """
        SELECT event_id, user_id AS entity, CASE event_type WHEN 'error' THEN 'predict_failed' WHEN 'signup'
                 THEN 'no_sheet_in_region' ELSE 'ok' END AS status, event_type AS kind,
               value, value / 500 AS recall, ts, props FROM {events}""",
    # arms and seeds of a comparison: volume x arm x seed with an endpoint
    "arms": """
        SELECT l_suppkey AS volume_id, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'B' ELSE 'C' END AS arm,
               CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END + 2 * (l_linenumber % 2) AS seed,
               l_quantity / 50 AS recall, l_discount AS loc_error, l_tax AS on_empty
        FROM {lineitem}""",
}

SQL_VIEWS = {
    name: re.sub(r"\{(\w+)\}", r"\1", body)
    .replace("ORIGIN", "1")
    .replace("UNNEST_21", "CAST(unnest(range(21)) AS INT)")
    .replace("UNNEST_5", "CAST(unnest(range(5)) AS INT)")
    for name, body in _VIEWS.items()
}
_SPARK_VIEWS = {
    name: body.replace("ORIGIN", "0")
    .replace("UNNEST_21", "explode(sequence(0, 20))")
    .replace("UNNEST_5", "explode(sequence(0, 4))")
    for name, body in _VIEWS.items()
}


class Tables:
    """Attribute access to the given parquet tables and to the views above."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in _SPARK_VIEWS:
            body = _SPARK_VIEWS[name]
            used = {t: getattr(self, t) for t in re.findall(r"\{(\w+)\}", body)}
            return self.spark.sql(body, **used)
        raise AttributeError(name)
