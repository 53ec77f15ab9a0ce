"""Text column functions: terms, markers, reply parsing, value formatting, canonical JSON and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in rule books.
STOP_WORDS = (
    "when is above below at or the makes more less likely weight held out auc accuracy cases source verified every rule kept only because set "
    "predicted that never saw and to of in for pattern book predicts data realistic synthetic from known generated this position holds view states "
    "argues doctrine claim it maintained with a an on by be are was"
).split()
TERM = r"([a-z][a-z0-9_]{3,})"
# Decimals shown for each feature of a shop session.
PLACES = {"Administrative": 0, "Administrative_Duration": 1, "Informational": 0, "Informational_Duration": 1, "ProductRelated": 0, "ProductRelated_Duration": 1, "BounceRates": 4, "ExitRates": 4, "PageValues": 2, "SpecialDay": 1}


def term_runs(text: Column) -> Column:
    """The lower-case words of at least four characters of a text in order, stop words included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(1))


def terms(text: Column) -> Column:
    """The terms of a text in order: lower-case words of at least four characters that are no stop words."""
    return F.filter(term_runs(text), lambda t: ~t.isin(STOP_WORDS))


def counted_terms(texts: Column) -> Column:
    """The different terms of an array of texts by name, as structs (term, tf, pos): how often, and the first place among a text's words.

    All is done within the row: terms are sorted, and a term's run ends where the next one starts.
    """
    places = F.transform(texts, lambda x: F.transform(term_runs(x), lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))
    kept = F.sort_array(F.flatten(places))

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["term"] != F.get(s, i - 1)["term"]))
        run = lambda i, end: F.struct(F.get(s, i)["term"].alias("term"), (end - i).cast("long").alias("tf"), F.get(s, i)["pos"].alias("pos"))
        of = lambda at: F.transform(at, lambda i, k: run(i, F.coalesce(F.get(at, k + 1), F.size(s))))
        return F.filter(F.get(F.transform(F.array(starts), of), F.lit(0)), lambda t: ~t["term"].isin(STOP_WORDS))

    # an array of one names its element: what is in it is worked out once
    return F.get(F.transform(F.array(kept), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(F.array().cast("array<struct<term:string,tf:bigint,pos:int>>"))), F.lit(0))


def count_marker(text: Column, marker: str) -> Column:
    """Occurrences of a marker in the lower-cased text, without overlaps."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return ((F.length(t) - F.length(F.replace(t, F.lit(marker), F.lit("")))) / len(marker)).cast("long")


def parse_reply(text: Column) -> Column:
    """The first run of digits as a score from 0 to 100; null if it has over three digits or exceeds 100."""
    run = F.regexp_extract(text, r"([0-9]+)", 1)
    value = F.when(F.length(run).between(1, 3), run.try_cast("int"))
    return F.when(value <= 100, value)


def reply_label(score: Column) -> Column:
    """1 from 50 on, 0 below, null for an unread reply."""
    return F.when(score.isNull(), F.lit(None).cast("int")).when(score >= 50, 1).otherwise(0)


def reply_score(score: Column) -> Column:
    """An unread reply counts as 50."""
    return F.coalesce(score, F.lit(50))


def format_value(feature: str, x: Column) -> Column:
    """A value with its feature's decimals; '' for an unknown feature or what is not a finite number."""
    if feature not in PLACES:
        return F.lit("")
    ok = F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return F.when(ok, F.format_string(f"%.{PLACES[feature]}f", x.cast("double"))).otherwise("")


# The lines of a run's report.
ORGAN_LINE, CUT_LINE = '  ✓ organ %s: held-out AUC %s on %s rows it never saw (target "%s")', "  ✗ CUT %s: %s"
BRAIN_LINE = "brain: %s organ(s) · %s B of seeds · mean held-out AUC %s · gate %s"
THINK_LINE, LABELLED = "think(a held-out %s case) -> %s", " (label %s, receipt %s…)"


def organ_line(name: Column, auc: Column, held: Column, target: Column, gate: float, error: Column | None = None) -> Column:
    """A domain's line of a report: its grade, or why it was cut (the error that it was refused with, or a grade below the gate)."""
    why = F.concat(F.lit("held-out AUC "), json_number(auc), F.lit(f" below gate {gate}"))
    why = why if error is None else F.coalesce(error, why)
    kept = F.coalesce(auc >= gate, F.lit(False)) & (F.lit(True) if error is None else error.isNull())
    return F.when(kept, F.format_string(ORGAN_LINE, name, json_number(auc), held.cast("string"), target)).otherwise(F.format_string(CUT_LINE, name, why))


def brain_line(organs: Column, size: Column, mean_auc: Column, gate: float) -> Column:
    """A report's last line: number, bytes and mean grade of the kept domains."""
    return F.format_string(BRAIN_LINE, organs.cast("string"), size.cast("string"), json_number(mean_auc), F.lit(str(gate)))


def think_line(name: Column, verdict: Column, label: Column, receipt_hash: Column) -> Column:
    """An answer in one line: verdict, and for verified ones label and the receipt's first twelve digits."""
    more = F.when(verdict == "VERIFIED", F.format_string(LABELLED, label.cast("string"), F.substring(receipt_hash, 1, 12))).otherwise("")
    return F.concat(F.format_string(THINK_LINE, name, verdict), more)


def json_number(x: Column) -> Column:
    """A double as JSON text in its shortest form: whole numbers without a fraction."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(x.isNull(), "null").when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))


def canonical_json(fields: dict[str, Column], opening: Column | None = None) -> Column:
    """A flat JSON object with its keys in the given order; values are ready JSON text. An opening (json_opening) comes before the fields."""
    parts: list[Column] = [] if opening is None else [opening]
    for k, v in fields.items():
        parts += [F.lit(("," if parts else "{") + f'"{k}":'), v]
    return F.concat(*parts, F.lit("}"))


def json_opening(fields: dict[str, Column]) -> Column:
    """The same object without its closing brace."""
    whole = canonical_json(fields)
    return F.substring(whole, F.lit(1), F.length(whole) - 1)


def json_string(x: Column) -> Column:
    """A JSON string of plain text (quotes and backslashes escaped)."""
    return F.when(x.isNull(), "null").otherwise(F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))


def digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def slug(text: Column) -> Column:
    """Lower case, runs of other than letters, digits and hyphens as one hyphen."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9-]+", "-")
