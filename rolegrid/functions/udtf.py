"""Table function over one page, for ad-hoc SQL. Jobs use the array expressions in ``html``."""

from __future__ import annotations

import re

from pyspark.sql.functions import udtf

_ANCHOR = re.compile(r"<a\b([^>]*)>(.*?)</a>", re.I | re.S)
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


@udtf(returnType="pos bigint, href string, label string")
class PageLinks:
    """Links of a page: position, href as written, text."""

    def eval(self, html: str):
        for pos, m in enumerate(_ANCHOR.finditer(html or "")):
            found = _HREF.search(m[1])
            href = next((g for g in found.groups() if g), "") if found else ""
            yield pos, href, " ".join(re.sub(r"<[^>]*>", " ", m[2]).split())
