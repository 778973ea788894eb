"""JSON out of model text: cleaning, typed decoding, and tries again for the rows that failed."""

from __future__ import annotations

import re
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from paperloom.functions.text import Py
from paperloom.plans.budget import ChainOptions, RetryPolicy
from paperloom.plans.chains import Chain
from paperloom.sources.stored import stored

FENCE_OPEN = r"```(?:json|JSON)?\s*\n?"
FENCE_CLOSE = r"\n?\s*```\s*$"
INVALID, MISMATCH, EXHAUSTED = "invalidJSON", "schemaMismatch", "retriesExhausted"
_OPEN = re.compile(FENCE_OPEN)
_CLOSE = re.compile(r"\n?\s*```\s*\Z")
#: A string, an opening or a closing bracket.
_PART = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}\[\]]', re.S)


def strip_fences(text: Column) -> Column:
    """What follows the first fence, without a fence at the very end."""
    return F.regexp_replace(F.regexp_replace(text, rf"(?s)^.*?{FENCE_OPEN}", ""), FENCE_CLOSE, "")


def _balanced(text: str, pair: str) -> tuple[int, int] | None:
    """From the first opening bracket to the one that closes it; brackets in strings do not count."""
    start = text.find(pair[0])
    depth = 0
    for m in _PART.finditer(text, start) if start >= 0 else ():
        depth += (m[0] == pair[0]) - (m[0] == pair[1])
        if m[0] == pair[1] and depth == 0:
            return start, m.end()
    return None


def outermost_json(text: str) -> str:
    """The object or array that starts first and is balanced, else the text without fences and outer blanks."""
    opened = _OPEN.search(text)
    bare = Py.strip(_CLOSE.sub("", text[opened.end() :] if opened else text))
    found = [s for s in (_balanced(bare, "{}"), _balanced(bare, "[]")) if s]
    return bare[slice(*min(found))] if found else bare


def extract_json(text: Column | str) -> Column:
    """``outermost_json`` of a column."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else outermost_json(t))

    return run(text)


def _missing(value: Column, schema: StructType) -> Column:
    out = value.isNull()
    for f in schema.fields:
        if not f.nullable:
            out = out | value[f.name].isNull()
    return out


def decoded(raw: Column, schema: StructType | ArrayType) -> tuple[Column, Column, Column]:
    """Cleaned JSON, the typed value, and the error: not JSON at all, or without the fields that must be there."""
    cleaned = extract_json(raw)
    return (cleaned, *decoded_clean(cleaned, schema))


def decoded_clean(cleaned: Column, schema: StructType | ArrayType) -> tuple[Column, Column]:
    value = F.from_json(cleaned, schema)
    row = schema.elementType if isinstance(schema, ArrayType) else schema
    wrong = (value.isNull() | F.exists(value, lambda v: _missing(v, row))) if isinstance(schema, ArrayType) else _missing(value, row)
    error = F.when(F.try_parse_json(cleaned).isNull(), F.lit(INVALID)).when(F.coalesce(wrong, F.lit(True)), F.lit(MISMATCH))
    return F.when(error.isNull(), value), error


def run_json(chain: Chain, docs: DataFrame, schema: StructType | ArrayType, map_prompt: str, reduce_prompt: str, stuff_prompt: str | None = None, system: str | None = None, options: ChainOptions | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, value, error, raw_text)``.

    Rows that failed are run again, with their error appended to the reduce prompt and without inner retries, up to
    the policy's attempts. Each round is written to the shared folder, so that no model is asked twice even if
    executors are lost. With a stuff prompt a document that
    takes one call never sees the hint. ``doc_id`` must be unique.
    """
    options = options or ChainOptions()
    attempts = options.retry.max_attempts
    left, done = docs.select("doc_id", "text", F.lit("").alias("hint")), None
    for attempt in range(1, attempts + 1):
        told = options if attempt == 1 else replace(options, retry=RetryPolicy())
        # the hint travels in its own column: the chain sees it as part of its input rows
        ran = _with_hint(chain, left, map_prompt, reduce_prompt, stuff_prompt, system, told)
        cleaned = ran.withColumn("cleaned", extract_json("text"))
        value, error = decoded_clean(F.col("cleaned"), schema)
        tried = cleaned.select("doc_id", value.alias("value"), F.coalesce("error", error).alias("error"), F.col("text").alias("raw_text"))
        tried = stored(tried)
        good = tried if attempt == attempts else tried.where("error IS NULL")
        if attempt == attempts and attempts > 1:
            good = good.withColumn("error", F.when(F.col("error").isNotNull(), F.concat(F.lit(f"{EXHAUSTED}: "), "error")))
        done = good if done is None else done.unionByName(good)
        if attempt < attempts:
            bad = tried.where("error IS NOT NULL").select("doc_id", F.concat(F.lit("\nThe answer before was not usable JSON: "), "error", F.lit("\nAnswer with valid JSON only.")).alias("hint"))
            left = docs.select("doc_id", "text").join(bad, "doc_id")
    return done


def _with_hint(chain: Chain, rows: DataFrame, map_prompt: str, reduce_prompt: str, stuff_prompt: str | None, system: str | None, options: ChainOptions) -> DataFrame:
    return chain.run(rows, map_prompt, reduce_prompt, stuff_prompt, system, options, hint=F.col("hint"))
