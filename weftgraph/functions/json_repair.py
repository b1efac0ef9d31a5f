"""Tolerant reading of JSON that a model wrote."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def read_json(raw: str | None, list_key: str | None = None) -> dict:
    """An object from ``raw``, whatever is around it.

    Code fences go. A bare array comes under ``list_key`` (``items`` without one). An object without
    ``list_key`` gives its first array under that key, if it has any. If the whole is no JSON, the
    outermost array is tried, then the outermost object; failing all, the result is empty.
    """
    text = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", raw or "").strip()
    spans = [text]
    for a, b in ("[]", "{}"):
        i, j = text.find(a), text.rfind(b)
        if 0 <= i < j:
            spans.append(text[i : j + 1])
    for span in spans:
        try:
            value = json.loads(span)
        except ValueError:
            continue
        if isinstance(value, list):
            return {list_key or "items": value}
        if isinstance(value, dict):
            if list_key and list_key not in value:
                other = next((v for v in value.values() if isinstance(v, list)), None)
                return value if other is None else {list_key: other}
            return value
    return {list_key: []} if list_key else {}


def repaired_json(c: Column | str, list_key: str | None = None) -> Column:
    """A text column as JSON text that ``from_json`` reads.

    A text that is one JSON object as it is (and, with ``list_key``, holds that key) stays as it is and never
    leaves the JVM; the rest is repaired in Arrow batches.
    """
    raw = F.col(c) if isinstance(c, str) else c

    def repair(s: pd.Series) -> pd.Series:
        return s.map(lambda x: json.dumps(read_json(x, list_key), ensure_ascii=False))

    valid = F.startswith(F.trim(raw), F.lit("{")) & F.json_object_keys(raw).isNotNull()
    if list_key:
        valid = valid & F.array_contains(F.json_object_keys(raw), list_key)
    return F.coalesce(F.when(valid, raw), F.pandas_udf(repair, "string")(F.when(~F.coalesce(valid, F.lit(False)), F.coalesce(raw, F.lit("")))))
