"""Scorecards: at most six threshold rules over one domain's features, their compact genomes, and scores as columns."""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrule.functions.numeric import Stream, finite, round_finite, round_up, round_up_py

MAX_RULES, MAX_FEATURES = 6, 16
#: The weights a rule can have, and the number of training quantiles (k+1)/16 it can cut at.
WEIGHTS = (-2.0, -1.0, -0.5, -0.25, 0.25, 0.5, 1.0, 2.0)
QUANTILES = tuple((k + 1) / 16 for k in range(15))


@dataclass(frozen=True)
class Rule:
    feat: str
    op: str
    v: float
    w: float

    def fires(self, x: Column | None = None) -> Column:
        """Whether the rule fires; what is absent or not finite never does."""
        x = F.col(self.feat).cast("double") if x is None else x
        return finite(x) & (x > self.v if self.op == ">" else x <= self.v)

    def text(self, outcome: str) -> str:
        side = "above" if self.op == ">" else "at or below"
        return f"  • when {self.feat} is {side} {plain(self.v)}  →  makes \"{outcome}\" {'MORE' if self.w > 0 else 'LESS'} likely  (weight {'+' if self.w > 0 else ''}{plain(self.w)})"


def plain(x: float) -> str:
    return str(int(x)) if x == int(x) else repr(x)


@dataclass(frozen=True)
class Gene:
    """One rule slot: whether it is on, and indices of feature, quantile, direction (1 is '>') and weight."""

    on: bool
    f: int
    q: int
    d: int
    w: int


Genome = tuple[Gene, ...]
STEM: Genome = tuple(Gene(True, r, 7, 1, 5) for r in range(MAX_RULES))


def encode(genome: Genome) -> str:
    """20 hex digits: a 6-bit mask, then 12 bits a rule (4 feature, 4 quantile, 1 direction, 3 weight), low bits first."""
    bits, at = sum(int(g.on) << r for r, g in enumerate(genome)), MAX_RULES
    for g in genome:
        bits |= (g.f | g.q << 4 | g.d << 8 | g.w << 9) << at
        at += 12
    return bits.to_bytes(10, "little").hex()


def decode(text: str) -> Genome:
    bits = int.from_bytes(bytes.fromhex(text), "little")
    part = lambda r: bits >> MAX_RULES + 12 * r
    return tuple(Gene(bool(bits >> r & 1), part(r) & 15, part(r) >> 4 & 15, part(r) >> 8 & 1, part(r) >> 9 & 7) for r in range(MAX_RULES))


def seed_text(domain: str, seed: int, payload: str, key: bytes = b"tallyrule") -> str:
    """A signed one-line seed: payload f:<genome> is a fixed card, g:population.elites.generations a search to run again."""
    body = f"◊ seed.v1 {domain} {seed} {payload}"
    return f"{body} {hmac.new(key, body.encode(), hashlib.sha256).hexdigest()[:12]}"


def read_seed(text: str, key: bytes = b"tallyrule") -> tuple[str, int, str] | None:
    """(domain, seed, payload), or None for anything but an unchanged seed."""
    parts = text.split(" ") if isinstance(text, str) else []
    if len(parts) != 6 or not parts[3].isdigit() or seed_text(parts[2], int(parts[3]), parts[4], key) != text:
        return None
    return parts[2], int(parts[3]), parts[4]


def random_genome(r: Stream, features: int) -> Genome:
    return tuple(Gene(r.coin(), r.below(features), r.below(15), r.below(2), r.below(8)) for _ in range(MAX_RULES))


def mutate(genome: Genome, r: Stream, features: int) -> Genome:
    """One slot redrawn in one of its parts."""
    k, part = r.below(MAX_RULES), r.below(5)
    g = genome[k]
    new = (Gene(not g.on, g.f, g.q, g.d, g.w), Gene(g.on, r.below(features), g.q, g.d, g.w), Gene(g.on, g.f, r.below(15), g.d, g.w), Gene(g.on, g.f, g.q, 1 - g.d, g.w), Gene(g.on, g.f, g.q, g.d, r.below(8)))[part]
    return genome[:k] + (new,) + genome[k + 1 :]


def cross(a: Genome, b: Genome, r: Stream) -> Genome:
    """Each slot from either parent."""
    return tuple(x if r.coin() else y for x, y in zip(a, b, strict=True))


def cuts(df: DataFrame, features: list[str]) -> dict[str, list[float]]:
    """The 15 training quantiles of each feature, one pass over (feature, value) counts: element floor(p*(n-1)) in order."""
    from tallyrule.operators.profile import order_statistics

    table = order_statistics(df, features, list(QUANTILES)).collect()  # 15 rows a feature
    out: dict[str, list[float]] = {f: [0.0] * len(QUANTILES) for f in features}
    for row in table:
        out[row["feature"]][QUANTILES.index(row["p"])] = round_up_py(row["value"])
    return out


def fit(genome: Genome, features: list[str], quantiles: dict[str, list[float]]) -> tuple[Rule, ...]:
    """The rules of a genome with thresholds from the training quantiles."""
    out = []
    for g in genome:
        if g.on:
            feat = features[g.f % len(features)]
            out.append(Rule(feat, ">" if g.d else "<=", quantiles[feat][min(g.q, 14)], WEIGHTS[g.w]))
    return tuple(out)


def score(rules: tuple[Rule, ...]) -> Column:
    """The sum of the weights of the rules that fire; weights are quarters, so any order gives the same double."""
    out = F.lit(0.0)
    for r in rules:
        out = out + F.when(r.fires(), F.lit(float(r.w))).otherwise(F.lit(0.0))
    return round_finite(out)


def score_map(rules: Column, values: Column) -> Column:
    """The same with rules as data (array of feat, op, v, w) over a map from feature to number."""

    def one(acc: Column, r: Column) -> Column:
        x = F.try_element_at(values, r["feat"])
        hit = finite(x) & F.when(r["op"] == ">", x > r["v"]).otherwise(x <= r["v"])
        return acc + F.when(hit, r["w"]).otherwise(F.lit(0.0))

    return round_up(F.aggregate(rules, F.lit(0.0), one))


def book(domain: str, outcome: str, rules: tuple[Rule, ...], held_auc: float, held_acc: float, held: int, source: str) -> str:
    """A card as text that people can read."""
    head = [f'PATTERN BOOK — {domain} (predicts: "{outcome}")', f"source: {source}", f"held-out AUC {held_auc} · held-out accuracy {held_acc} · {held} held-out cases", ""]
    return "\n".join(head + ([r.text(outcome) for r in rules] or ["  (no rule passed the gate: this card abstains)"]))
