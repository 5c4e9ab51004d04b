"""License texts and notices to look for. The published wording, without the copyright line."""

MIT_BODY = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""

BSD_CONDITIONS = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution.
"""

BSD_ENDORSEMENT = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""

BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""

ISC_BODY = """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS
IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""

APACHE_NOTICE = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License.
"""

GPL_NOTICE = """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
"""

MPL_NOTICE = """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""

LGPL_NOTICE = """
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
"""

GPL_2_NOTICE = GPL_NOTICE.replace("version 3", "version 2")
AGPL_NOTICE = GPL_NOTICE.replace("GNU General", "GNU Affero General")
LGPL_3_NOTICE = GPL_NOTICE.replace("GNU General", "GNU Lesser General")

GPL_LINE = "This work is licensed under the GNU General Public License, version 3."

# longer texts first: of equally covered templates the first is reported
TEMPLATES = {
    "BSD-3-Clause": BSD_CONDITIONS + BSD_ENDORSEMENT + BSD_DISCLAIMER,
    "BSD-2-Clause": BSD_CONDITIONS + BSD_DISCLAIMER,
    "MIT": MIT_BODY,
    "ISC": ISC_BODY,
    "Apache-2.0": APACHE_NOTICE,
    "AGPL-3.0-or-later": AGPL_NOTICE,
    "LGPL-2.1-or-later": LGPL_NOTICE,
    "LGPL-3.0-or-later": LGPL_3_NOTICE,
    "GPL-3.0-or-later": GPL_NOTICE,
    "GPL-2.0-or-later": GPL_2_NOTICE,
    "MPL-2.0": MPL_NOTICE,
    "AGPL-3.0 (line)": GPL_LINE.replace("GNU", "GNU Affero"),
    "LGPL-3.0 (line)": GPL_LINE.replace("GNU", "GNU Lesser"),
    "LGPL-2.1 (line)": GPL_LINE.replace("GNU", "GNU Lesser").replace("3.", "2.1."),
    "GPL-3.0 (line)": GPL_LINE,
    "GPL-2.0 (line)": GPL_LINE.replace("3.", "2."),
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "MPL-2.0 (line)": "Licensed under the Mozilla Public License, Version 2.0.",
    "CC-BY-NC-SA-4.0 (line)": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0 (line)": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 (line)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0 (line)": "Licensed under CC BY-ND 4.0.",
    "CC-BY-4.0 (line)": "Licensed under CC BY 4.0.",
    "CC0-1.0 (line)": "Licensed under CC0 1.0.",
    "MIT (line)": "Released under the MIT License.",
    "BSD (line)": "Released under the BSD License.",
    "ISC (line)": "Released under the ISC License.",
}

# phrases without which a passage is another license, however many of the other words it has
MARKS = {
    "BSD-3-Clause": ["neither the name|endorse or promote|specific prior written permission"],
    "AGPL-3.0-or-later": ["GNU Affero General", "version 3"],
    "LGPL-2.1-or-later": ["GNU Lesser General", "version 2.1"],
    "LGPL-3.0-or-later": ["GNU Lesser General", "version 3"],
    "GPL-3.0-or-later": ["GNU General", "version 3"],
    "GPL-2.0-or-later": ["GNU General", "version 2"],
    "MPL-2.0": ["Mozilla Public License", "2.0"],
    "AGPL-3.0 (line)": ["GNU Affero General", "version 3"],
    "LGPL-3.0 (line)": ["GNU Lesser General", "version 3"],
    "LGPL-2.1 (line)": ["GNU Lesser General", "version 2.1"],
    "GPL-3.0 (line)": ["GNU General", "version 3"],
    "GPL-2.0 (line)": ["GNU General", "version 2"],
    "Apache-2.0": ["Apache License", "Version 2.0"],
    "Apache-2.0 (line)": ["Apache License", "Version 2.0"],
    "MPL-2.0 (line)": ["Mozilla Public License", "Version 2.0"],
    **{f"CC-{k}-4.0 (line)": [f"CC {k} 4.0"] for k in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")},
    "CC0-1.0 (line)": ["CC0 1.0"],
    "MIT (line)": ["MIT License"],
    "BSD (line)": ["BSD License"],
    "ISC (line)": ["ISC License"],
}
