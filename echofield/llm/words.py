"""What the text classifiers share: folded words, and training rows within a bound."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: Runs of letters, with the digits and signs that stand for letters in misspellings inside or before them.
TOKEN = re.compile(r"[^\W_](?:[\w@$!]*[^\W_])?")


def folded(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def chosen_texts(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with an id among a bounded number of them, which is why they can be sent to every executor."""
    from pyspark.sql import functions as F

    return documents.join(F.broadcast(ids), "doc_id")
