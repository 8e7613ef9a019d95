"""Whole texts that are a known licence, found by the digest of a canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, text_of

#: Words that licences spell in more than one way, and the spelling used here.
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "licencing": "licensing",
    "licencee": "licensee",
    "licencees": "licensees",
    "licencor": "licensor",
    "licencors": "licensors",
    "relicencing": "relicensing",
    "sublicence": "sublicense",
    "sublicences": "sublicenses",
    "sublicencing": "sublicensing",
    "sub license": "sublicense",
    "sub licence": "sublicense",
    "organisation": "organization",
    "modelled": "modeled",
    "favour": "favor",
    "whilst": "while",
    "wilful": "willful",
    "labour": "labor",
    "judgement": "judgment",
    "acknowledgement": "acknowledgment",
    "copyright owner": "copyright holder",
    "non commercial": "noncommercial",
    "per cent": "percent",
    "merchantibility": "merchantability",
    "https": "http",
}

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Public licence texts by SPDX identifier, without their copyright lines. A title may precede each.
TEXTS = {
    "MIT": ("MIT License", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n' + _WARRANTY),
    "MIT-0": ("MIT No Attribution", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n' + _WARRANTY),
    "ISC": ("ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY),
    "0BSD": ("BSD Zero Clause License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_WARRANTY),
    "BSD-2-Clause": ("BSD 2-Clause License", _BSD_HEAD + _BSD_TAIL),
    "BSD-3-Clause": ("BSD 3-Clause License", _BSD_HEAD + _BSD_NAME + _BSD_TAIL),
    "Zlib": ("zlib License", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    "Unlicense": ("The Unlicense", 'This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\nFor more information, please refer to <http://unlicense.org/>'),
    "Apache-2.0-notice": ("Apache License Notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    "Apache-2.0-line": ("Apache License Notice", "Licensed under the Apache License, Version 2.0."),
    "MIT-line": ("MIT License Notice", "Released under the MIT License."),
    "CC-BY-NC-4.0-line": ("Creative Commons Notice", "Licensed under CC BY-NC 4.0."),
    "GPL-3.0-line": ("GNU License Notice", "This work is licensed under the GNU General Public License, version 3."),
}

# SHA-256 of the canonical form of long public licences by SPDX identifier: the whole text and, where it has an
# appendix after its terms, the terms without and with the line that ends them.
DIGESTS = {
    "Apache-2.0": ("7844dc1252bff1ce25b457cb21ec83758e732eee603390bdc58fdc608970eb1e", "25ac8b79dac2fc8d980e3be1bd30316baeb74886a02a18180ab473222097a4a7", "d224790a1918de54812b7b4bf154fd2ab67a9048cf8eb6377d6e2606fffd2aab"),
    "Artistic-1.0-Perl": ("4834e699353522cfb463bd8b374752ecf02156bb3f5dfb53d0edb502a112a651",),
    "CC0-1.0": ("51c4bf27767d074bdefc84db7420b4c55e27827dac6d8de3ef0d37b2042fb6fa",),
    "GFDL-1.2": ("7bd3a9b625b0b9c72d575e34948a31aa1d9a92600e54323c0abd84a9844ce82d",),
    "GFDL-1.3": ("53f9a16968b5537fb511bc14739b50ed593dcbb894a238b41225328617b367dd",),
    "GPL-1.0": ("b9f815d5c5f4694789930d0e2241721f6cdddac1ab09ef76b26b669b819c94d7", "2d78faa22a4757fcedfccd908c3aa08e489d3fd836d0ca14c1451e75d337c76c", "e0680dcd6d44a494ffd1b994b55600070b9bc6e43dde99f464055b361169aa4c"),
    "GPL-2.0": ("7184d26d84b872ba4d2f7f785abf2f2e9fa24bb587420a49515d6d61713c52bb", "7a30337378dccdc68d09e3adfb467c14d8d2aafa9ed54b301a5a40a2cbe1c6c7", "c96bbd300040e473c5c8c1406c85b75af765d5f4035156ef4962ce0c62ac5faa"),
    "GPL-3.0": ("bd7328918ecee5d4124586097537cc86fbe5616cd6c36107d0bee228d12898bc", "d4211e42e6dfb961d4b5f932b994ecaf25ba9446836da801fee6535aa9fa6b25", "4671d5b2b1066ae8112f48b114054efb01163ffef85367f8994fbc430d73ecd9"),
    "LGPL-2.0": ("4a1b1cb15d45262f049457ae26945909d0e5af93e2e3fb5de82c9f72ac6bebe2", "9445838f80c534db1f71155f4c93f1464bf680d2a091792f3f2146f5cefef806", "2894b2cb46a2c83844eec54a57337498c55bc0779fe2dbdd14bc94a567a3c32e"),
    "LGPL-2.1": ("f2755dc4b609b314faab32d30ca6d0466b60adc931cece2ea4f0b61f483bfc98", "70a277553f5f0e974016dfc6aed9adda07c554792c5f1f3d75acb63053de3f89", "303c35384a2d8ff561e8480f4d8bc87bd79ea2d92d62ba0b24d22e2c1f88f1e3"),
    "LGPL-3.0": ("cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45",),
    "MPL-1.1": ("7d7a53e6d1196da0b05df71a72f3dea9734563b16290b2d09dd514624679872e",),
    "MPL-2.0": ("35ef3bd6b8dde2c220e6e747059cfe96815135ddffa77f412609dea3108d65a6",),
}

# In order: lines that state a copyright or reserve rights, marks before list items, everything but letters and digits.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[ \t]*(\(c\)|©|copyright|by|[0-9<\[{])[^\n]*$|^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
LIST_MARK = r"(?m)^[ \t]*([0-9]{1,2}|[a-z])[.)][ \t]+"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The text in lower case without copyright lines, list marks and punctuation, each spelling made one."""
    out = F.lower(F.regexp_replace(text, r"\r\n?", "\n"))
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT_LINE, ""), LIST_MARK, "")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, NOT_WORD, " ")), F.lit(" "))
    for other, usual in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {usual} "))
    return F.trim(out)


def known_licenses(spark, texts: dict[str, tuple[str, str]] | None = None, digests: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(license, canonical_sha256) of known texts, each with and without its title, and of known digests: a few rows a licence."""
    rows = [(k, v) for k, (title, body) in (TEXTS if texts is None else texts).items() for v in (body, f"{title}\n{body}")]
    ready = [(k, v) for k, ds in (DIGESTS if digests is None else digests).items() for v in ds]
    named = spark.createDataFrame(rows, "license string, text string").select("license", F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"))
    both = named.unionByName(spark.createDataFrame(ready, "license string, canonical_sha256 string"))
    return both.groupBy("canonical_sha256").agg(F.min("license").alias("license"))


def find_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, license (null if its whole text is no known one) and canonical_sha256.

    Two texts have one canonical form if they differ in case, punctuation, white space, list marks, copyright lines and
    the spellings of SPELLINGS alone. Known digests are few, as many as licences, and are broadcast; if given by the
    caller, Spark decides by their size. Null counts as empty, and no licence is empty. Of licences with one digest the
    first by name counts. Repeated rows and null ids stay; other columns are ignored; an empty table gives an empty result.
    """
    own = known is None
    known = (known_licenses(docs.sparkSession) if own else known).select(F.col("canonical_sha256").alias("_digest"), "license")
    rows = docs.select(quoted(id_col).alias("_id"), F.sha2(canonical(text_of(text_col)), 256).alias("canonical_sha256"))
    joined = rows.join(F.broadcast(known) if own else known, F.col("canonical_sha256") == F.col("_digest"), "left")
    return joined.select(F.col("_id").alias(id_col), "license", "canonical_sha256")
