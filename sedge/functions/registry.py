"""The engine's functions for SQL: expressions as SQL functions, which the optimizer sees through, and table functions."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import text as T


@udtf(returnType="chunk_index int, content string")
class ChunkText:
    """``chunk_text(text, budget)``: lines merged until a chunk has more than ``budget`` words."""

    def eval(self, text: str, budget: int):
        chunk, words, no = [], 0, 0
        for line in (text or "").split("\n"):
            if not line.strip(" "):
                continue
            if words > budget:
                yield no, "\n".join(chunk)
                chunk, words, no = [], 0, no + 1
            chunk.append(line)
            words += len(re.split(r"\s+", line.strip(" "), flags=re.ASCII))
        if chunk:
            yield no, "\n".join(chunk)


@udtf(returnType="chunk_index int, content string")
class SplitJson:
    """``split_json(text, most)``: the portions of a JSON value of under ``most`` characters each; none of other texts."""

    def eval(self, text: str, most: int):
        from ..operators.chunking import json_portions

        try:
            yield from enumerate(json_portions(text, most, max(most - 200, 50)))
        except (TypeError, ValueError):
            return


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session; their names."""
    wide = "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "　"
    narrow = ("".join(chr(x) for x in range(0x21, 0x7F)) + " ").replace("\\", "\\\\").replace("'", "\\'")
    dot = "aggregate(zip_with(a, b, (x, y) -> x * y), CAST(0 AS DOUBLE), (s, x) -> s + x)"
    functions = {
        "half_width(t STRING) RETURNS STRING": f"translate(t, '{wide}', '{narrow}')",
        "rag_tokenize(t STRING) RETURNS ARRAY<STRING>": f"regexp_extract_all(lower(t), '{T.TOKEN}', 0)",
        "count_tokens(t STRING) RETURNS BIGINT": "CASE WHEN trim(t) = '' THEN 0 ELSE size(split(trim(t), '\\\\s+')) END",
        "vector_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": f"{dot} / nullif(sqrt({dot.replace('b,', 'a,')}) * sqrt({dot.replace('(a,', '(b,')}), 0)",
    }
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("split_json", SplitJson)
    return [h.split("(")[0] for h in functions] + ["chunk_text", "split_json"]
