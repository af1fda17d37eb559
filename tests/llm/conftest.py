from __future__ import annotations

import pytest

from flowspark.llm.tables import prepare

#: Names the operators use inside; documents that have them too must not confuse anything.
CLASHES = ("code", "node", "tile", "part", "item", "score", "x", "dim", "block", "window", "chosen_id", "root", "q", "row")
LONG = "An " + "anan therble ingtion ofthe\n" * 6000


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows and ids, clashing columns."""
    prepare(spark)
    texts = [None, "", " \n ", "Was there ing", "Was there ing", LONG, "ñ ñandú ción", "123 456 !!", "a", "Was  there\ting\r\n"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (3, "another text of three", None, None, None), (None, None, None, None, None), (None, "null id", "fr", "s", 3), (-5, "x" * 70_000, "de", None, 1)]
    full = [(*r, *([None if r[0] == 1 else "7"] * len(CLASHES))) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)).repartition(3)
