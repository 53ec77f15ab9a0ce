"""Sealed comparisons: the plan in a text, prompts made from it, their digests, and hashed receipts of results."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrule.functions.text import digest, format_value


def read_seal(text: str, test: str) -> dict | None:
    """The first fenced JSON block of a text if it is the plan of the named test with prompt lines; else None."""
    block = re.search(r"```json\n(.*?)\n```", text, re.S) if isinstance(text, str) else None
    try:
        plan = json.loads(block[1]) if block else None
    except ValueError:
        return None
    return plan if isinstance(plan, dict) and plan.get("test") == test and isinstance(plan.get("prompt"), list) else None


def sealed_lines(text: Column, test: str) -> Column:
    """read_seal as a column: the prompt lines of the named test's plan in a text, else null."""
    plan = F.from_json(F.regexp_extract(text, r"(?s)```json\n(.*?)\n```", 1), "test string, prompt array<string>")
    return F.when(plan["test"] == test, plan["prompt"])


def prompt(lines: list[str], book: str | None = None) -> Column:
    """The prompt lines with {feature} replaced by the row's value as that feature is shown, after a book and a blank line if there is one."""
    parts: list[Column] = [F.lit(book.strip() + "\n\n")] if isinstance(book, str) else []
    for piece in re.split(r"(\{\w+\})", "\n".join(map(str, lines))):
        hole = re.fullmatch(r"\{(\w+)\}", piece)
        parts.append(format_value(hole[1], F.col(hole[1])) if hole else F.lit(piece))
    return F.concat(*parts)


def check_prompts(log: DataFrame, made: DataFrame, keys: list[str]) -> DataFrame:
    """The logged calls with sealed: whether the logged digest is that of the prompt made again (false if there is none)."""
    again = made.select(*keys, digest(F.col("prompt")).alias("_again"))
    return log.join(again, keys, "left").withColumn("sealed", F.coalesce(F.col("prompt_sha256") == F.col("_again"), F.lit(False))).drop("_again")


def covers(rows: DataFrame, arm: str, key: str, total: int) -> DataFrame:
    """(arm, covers): whether an arm has a value for each of `total` sample rows."""
    return rows.groupBy(arm).agg((F.countDistinct(key) == total).alias("covers"))


def hashed(core: dict) -> dict:
    """A result with the digest of its compact JSON in the given key order."""
    return {**core, "receiptHash": hashlib.sha256(json.dumps(core, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()}


def genuine(receipt) -> bool:
    """Whether a receipt's digest is that of its other fields; False for anything else."""
    if not isinstance(receipt, dict) or not isinstance(receipt.get("receiptHash"), str):
        return False
    return hashed({k: v for k, v in receipt.items() if k != "receiptHash"})["receiptHash"] == receipt["receiptHash"]
