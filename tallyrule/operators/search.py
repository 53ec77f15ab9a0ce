"""Search for scorecards: the driver breeds genomes, Spark scores whole generations at once.

Data enter the search once, as counts of distinct (bin codes, y, part) vectors: bin k of a feature is the number of training quantiles
below the value, and a rule at quantile q fires exactly if bin > q. If the counts are few (their number is checked), they are fetched
once and generations are scored on the driver. Else a generation is one job: candidates go out as an array column, each
count row is scored for all of them, and (candidate, score, y) histograms come back.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrule.functions.numeric import Stream, round_up, round_up_py, seed_number
from tallyrule.functions.text import digest
from tallyrule.operators import metrics
from tallyrule.operators.profile import fingerprints
from tallyrule.operators.routing import GATE_AUC, Pattern
from tallyrule.operators.scorecard import MAX_FEATURES, MAX_RULES, STEM, WEIGHTS, Gene, Genome, book, cross, cuts, decode, encode, fit, mutate, random_genome, read_seed, score, seed_text
from tallyrule.operators.splitting import stratified


@dataclass(frozen=True)
class Effort:
    population: int = 44
    elites: int = 6
    generations: int = 44


QUICK, WORKER, VIEW = Effort(24, 4, 16), Effort(20, 4, 14), Effort(16, 3, 12)


class Arena:
    """Fitness of genomes on parts of a domain ('fit' rows set the quantiles, 'val' rows judge); answers are remembered."""

    def __init__(self, df: DataFrame, features: list[str], part: Column, fitting: str = "fit", most_local: int = 200_000) -> None:
        self.features = features[:MAX_FEATURES]
        if len(features) > MAX_FEATURES:
            warnings.warn(f"a genome can name {MAX_FEATURES} features; left out: {', '.join(features[MAX_FEATURES:])}", stacklevel=2)
        rows = df.withColumn("_part", part)
        self.cuts = cuts(rows.where(F.col("_part") == fitting), self.features)
        code = lambda f: sum((F.coalesce(F.col(f), F.lit(float("-inf"))) > v).cast("int") for v in self.cuts[f]).cast("tinyint")
        binned = rows.select("_part", F.col("y").cast("int").alias("y"), *[code(f).alias(f) for f in self.features])
        self.counts = binned.groupBy("_part", "y", *self.features).agg(F.count("*").alias("n")).cache()
        self.known: dict[tuple[str, str], float] = {}
        self.local = None
        if self.counts.limit(most_local + 1).count() <= most_local:
            table = self.counts.toPandas()
            self.local = {p: (t[self.features].to_numpy(), t["y"].to_numpy(), t["n"].to_numpy(float)) for p, t in table.groupby("_part")}

    def close(self) -> None:
        self.counts.unpersist()

    def _histograms(self, genomes: list[Genome], part: str) -> DataFrame:
        """(candidate, score, pos, neg) of all genomes in one job: a column of scores for each, unpivoted after the scoring."""
        entries = []
        for i, g in enumerate(genomes):
            s = F.lit(0.0)
            for x in g:
                if x.on:
                    over = F.col(self.features[x.f % len(self.features)]) > min(x.q, 14)
                    s = s + F.when(over if x.d else ~over, F.lit(WEIGHTS[x.w])).otherwise(F.lit(0.0))
            entries.append(F.struct(F.lit(i).alias("candidate"), s.alias("score")))
        rows = self.counts.where(F.col("_part") == part).select("y", "n", F.explode(F.array(*entries)).alias("c"))
        return rows.groupBy("c.candidate", "c.score").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg"))

    def _auc_here(self, genome: Genome, part: str) -> float:
        """AUC of a genome over the fetched counts."""
        if part not in self.local:
            return 0.5
        codes, y, n = self.local[part]
        total = np.zeros(len(y))
        for x in genome:
            if x.on:
                over = codes[:, x.f % len(self.features)] > min(x.q, 14)
                total += WEIGHTS[x.w] * (over if x.d else ~over)
        _, at = np.unique(total, return_inverse=True)
        pos, neg = np.bincount(at, n * (y == 1)), np.bincount(at, n * (y == 0))
        if not pos.sum() or not neg.sum():
            return 0.5
        won = (pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum())
        return round_up_py(float(won))

    def fitness(self, genomes: list[Genome], part: str = "val") -> list[float]:
        """AUC of each genome on a part; those not met before are scored together."""
        names = [encode(g) for g in genomes]
        new = {n: g for n, g in zip(names, genomes, strict=True) if (part, n) not in self.known}
        if new and self.local is not None:
            self.known |= {(part, n): self._auc_here(g, part) for n, g in new.items()}
        elif new:
            found = {r["candidate"]: r["auc"] for r in metrics.auc(self._histograms(list(new.values()), part), ["candidate"]).collect()}
            for i, n in enumerate(new):
                self.known[part, n] = found.get(i, 0.5)
        return [self.known[part, n] for n in names]


def deepen(arena: Arena, seed: int, effort: Effort, stems: list[Genome] | None = None) -> Genome:
    """The best genome after warm-started generations: stems, two mutants of each and random ones; elites stay, tournaments of two breed.

    Of equal fitness the earlier born wins, so a result depends on seed and data only.
    """
    r, wide = Stream(seed * 7919 + 1), len(arena.features)
    first: list[Genome] = []
    for s in stems or [STEM]:
        first += [s, mutate(s, r, wide), mutate(s, r, wide)]
    first += [random_genome(r, wide) for _ in range(effort.population - len(first))]
    born = 0

    def live(genomes: list[Genome]) -> list[tuple[float, int, Genome]]:
        nonlocal born
        out = [(-f, born + i, g) for i, (f, g) in enumerate(zip(arena.fitness(genomes), genomes, strict=True))]
        born += len(genomes)
        return out

    pop = live(first)
    for _ in range(effort.generations - 1):
        battle = lambda: min(pop[r.below(len(pop))], pop[r.below(len(pop))])[2]  # noqa: B023, E731
        elites = sorted(pop)[: effort.elites]
        children = []
        while len(elites) + len(children) < effort.population:
            child = cross(battle(), battle(), r)
            children.append(mutate(child, r, wide) if r.coin() else child)
        pop = elites + live(children)
    return min(pop)[2]


def inner_parts() -> Column:
    """fit/val of the training rows by the stratified split already in column _inner, test for held-out rows."""
    return F.when(F.col("split") == "held", "test").when(F.col("_inner") == "held", "val").otherwise("fit")


def with_inner(df: DataFrame, share: float, seed: int) -> DataFrame:
    """Training rows get _inner by a stratified seeded split; held-out rows take no part in it."""
    train = stratified(df.where(F.col("split") == "train").drop("split"), "row_id", "y", share, seed).withColumnRenamed("split", "_inner").withColumn("split", F.lit("train"))
    return train.unionByName(df.where(F.col("split") == "held").withColumn("_inner", F.lit(None).cast("string")))


def pattern(df: DataFrame, domain: str, features: list[str], genome: Genome, seed: int) -> Pattern:
    """Fit a genome on all training rows, grade it on the held-out rows, and take the training fingerprints."""
    train, held = df.where(F.col("split") == "train"), df.where(F.col("split") == "held")
    rules = fit(genome, features, cuts(train, features))
    point = metrics.operating_point(metrics.histogram(train, score(rules), F.col("y"))).first()
    h = metrics.histogram(held, score(rules), F.col("y"))
    graded = metrics.auc(h).first()
    acc = h.agg(metrics.accuracy(h, F.lit(point["threshold"])).alias("a")).first()["a"]
    prints = {r["feature"]: (r["lo"], r["q1"], r["med"], r["q3"], r["hi"]) for r in fingerprints(train, features).collect()}
    text = seed_text(domain, seed, f"f:{encode(genome)}")
    key = df.sparkSession.range(1).select(F.substring(digest(F.lit(f"{domain}|{text}|{rules}")), 1, 16)).first()[0]
    return Pattern(domain, tuple(features), rules, point["threshold"], point["spread"], point["base"], graded["auc"], acc, graded["pos"] + graded["neg"], prints, key, text)


def grow(df: DataFrame, domain: str, features: list[str], seed: int = 7, effort: Effort = QUICK, stems: list[Genome] | None = None) -> Pattern:
    """Search on an inner third of the training rows and grade the champion on the held-out rows."""
    rows = with_inner(df, 1 / 3, seed)
    arena = Arena(rows, features, inner_parts())
    try:
        return pattern(df, domain, features, deepen(arena, seed, effort, stems), seed)
    finally:
        arena.close()


def germinate(df: DataFrame, features: list[str], text: str) -> Pattern | None:
    """The pattern a seed stands for: its fixed card fitted, or its search run again. None for anything but a genuine seed."""
    found = read_seed(text)
    if found is None:
        return None
    domain, seed, payload = found
    if payload.startswith("f:"):
        return pattern(df, domain, features, decode(payload[2:]), seed)
    return grow(df, domain, features, seed, Effort(*map(int, payload[2:].split("."))))


@dataclass(frozen=True)
class Library:
    """Verified patterns by domain, what was cut and why, and sizes."""

    patterns: dict[str, Pattern]
    cut: tuple[dict, ...]

    @property
    def mean_auc(self) -> float:
        return round(sum(p.held_auc for p in self.patterns.values()) / len(self.patterns), 6) if self.patterns else 0.0

    @property
    def seed_bytes(self) -> int:
        return sum(len(p.seed.encode()) for p in self.patterns.values())

    @property
    def grown_bytes(self) -> int:
        return sum(len(repr((p.rules, p.base, p.threshold, p.prints)).encode()) for p in self.patterns.values())

    @property
    def ratio(self) -> float:
        return round(self.grown_bytes / self.seed_bytes, 6) if self.seed_bytes else 0.0


def build_library(domains: dict[str, tuple[DataFrame, list[str]]], seed: int = 7, effort: Effort = QUICK) -> Library:
    """A pattern for each domain; those that do not reach the gate on held-out rows are cut."""
    kept, cut = {}, []
    for name, (df, features) in domains.items():
        p = grow(df, name, features, seed, effort)
        if p.verified:
            kept[name] = p
        else:
            cut.append({"domain": name, "heldAuc": p.held_auc, "why": f"held-out AUC {p.held_auc} below gate {GATE_AUC}"})
    return Library(kept, tuple(cut))


def grow_tier(before: Library, domains: dict[str, tuple[DataFrame, list[str]]], effort: Effort = Effort(), genomes: dict[str, Genome] | None = None) -> Library:
    """The next tier: known domains searched deeper from their champion and kept unless worse, new domains added if they pass the gate."""
    kept, cut = {}, []
    for name, p in before.patterns.items():
        kept[name] = p
        if name in domains:
            df, features = domains[name]
            new = grow(df, name, features, seed_number(name) + 1, effort, [(genomes or {}).get(name, STEM)])
            kept[name] = new if new.held_auc >= p.held_auc else p
    for name, (df, features) in domains.items():
        if name not in kept:
            p = grow(df, name, features, seed_number(name), effort)
            if p.verified:
                kept[name] = p
            else:
                cut.append({"domain": name, "heldAuc": p.held_auc, "why": f"held-out AUC {p.held_auc} below gate {GATE_AUC}"})
    return Library(kept, tuple(cut))


def tier_receipt(before: DataFrame, after: DataFrame) -> DataFrame:
    """(domain, auc_before, auc_after, monotone, added) of two tiers (domain, auc): no domain may be lost or fall by over 1e-9."""
    both = before.select("domain", F.col("auc").alias("auc_before")).join(after.select("domain", F.col("auc").alias("auc_after")), "domain", "full")
    ok = F.coalesce(F.col("auc_after") >= F.col("auc_before") - 1e-9, F.lit(False))
    return both.select("domain", "auc_before", "auc_after", F.when(F.col("auc_before").isNotNull(), ok).alias("monotone"), F.col("auc_before").isNull().alias("added"))


Hypothesis = tuple[str, str]


def parse_hypotheses(text: str, features: list[str]) -> list[Hypothesis]:
    """(feature, 'high' or 'low') from a JSON list in a reply, or else from the words after each feature's name; at most six."""
    import json
    import re

    low = re.compile(r"low|below|less|down", re.I)
    names = {f.lower(): f for f in features}
    found: dict[str, str] = {}
    span = re.search(r"\[.*\]", str(text), re.S)
    try:
        listed = json.loads(span[0]) if span else []
    except ValueError:
        listed = []
    for h in listed if isinstance(listed, list) else []:
        name = names.get(str(h.get("feature", "")).lower()) if isinstance(h, dict) else None
        if name:
            found.setdefault(name, "low" if low.search(str(h.get("direction", ""))) else "high")
    if not found:
        flat = str(text).lower()
        for key, name in names.items():
            at = flat.find(key)
            if at >= 0:
                found[name] = "low" if low.search(flat[at : at + len(key) + 40]) else "high"
    return list(found.items())[:MAX_RULES]


def genome_of(hypotheses: list[Hypothesis], features: list[str]) -> Genome:
    """One rule at the median for each hypothesis, weight +1; the stem if there is none."""
    slots = [Gene(True, features.index(f), 7, int(d == "high"), 6) for f, d in hypotheses[:MAX_RULES] if f in features]
    return tuple(slots + [Gene(False, r % MAX_FEATURES, 7, 1, 6) for r in range(len(slots), MAX_RULES)]) if slots else STEM


def forge(df: DataFrame, domain: str, features: list[str], proposers: dict[str, str | None], outcome: str = "the positive outcome", seed: int = 7, effort: Effort = Effort(), source: str = "the domain table") -> dict:
    """Proposals (a reply's text for each member, None where a member is down) against bred cards, all judged on an inner quarter.

    The pool is every proposal, what is bred from it, and what is bred from the stem (always). The first of the best wins; a cross of
    the two best takes over only if it beats both; a last search from the champion takes over unless it is worse. The held-out rows
    grade only the final card.
    """
    rows = with_inner(df, 0.25, seed)
    arena = Arena(rows, features, inner_parts())
    try:
        pool: dict[str, Genome] = {}
        dropped = []
        for who, reply in proposers.items():
            if reply is None:
                dropped.append(who)
                continue
            g = genome_of(parse_hypotheses(reply, features), features)
            pool[f"{who}"] = g
            pool[f"bred from {who}"] = deepen(arena, seed, effort, [g])
        pool["bred from stem"] = deepen(arena, seed + 1, effort)
        board = list(zip(pool, arena.fitness(list(pool.values())), strict=True))
        ranked = sorted(board, key=lambda x: -x[1])
        (how, val), champion = ranked[0], pool[ranked[0][0]]
        if len(ranked) > 1:
            child = cross(champion, pool[ranked[1][0]], Stream(seed * 104729 + 3))
            child_val = arena.fitness([child])[0]
            if child_val > ranked[0][1]:
                how, val, champion = f"cross of {ranked[0][0]} and {ranked[1][0]}", child_val, child
        last = deepen(arena, seed + 2, effort, [champion])
        last_val = arena.fitness([last])[0]
        if last_val >= val:
            how, val, champion = f"{how}, observed", last_val, last
    finally:
        arena.close()
    p = pattern(df, domain, features, champion, seed)
    return {"pattern": p, "selected_by": how, "val_auc": val, "scoreboard": ranked, "dropped": dropped, "book": book(domain, outcome, p.rules, p.held_auc, p.held_acc, p.held, source)}


def grow_ensemble(df: DataFrame, domain: str, features: list[str], workers: int = 8, seed: int = 11, effort: Effort = WORKER) -> list[Pattern]:
    """Workers searched from different seeds."""
    return [grow(df, domain, features, seed + 131 * k + 1, effort) for k in range(workers)]


def resolve(cards: list[tuple], mean_std: dict[int, tuple[float, float]]) -> Column:
    """The ensemble score: each worker's standardised score times max(0, AUC - 0.5) squared. cards: (rules, held AUC)."""
    total = F.lit(0.0)
    for i, (rules, held_auc) in enumerate(cards):
        mean, std = mean_std[i]
        total = total + F.lit(max(0.0, held_auc - 0.5) ** 2) * ((score(rules) - F.lit(mean)) / F.lit(std or 1.0))
    return round_up(total)


def worker_scales(train: DataFrame, cards: list[tuple]) -> dict[int, tuple[float, float]]:
    """Mean and population deviation of each worker's training scores, in one pass."""
    row = train.agg(*[f(score(rules)).alias(f"{n}{i}") for i, (rules, _) in enumerate(cards) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {i: (round(row[f"m{i}"] or 0.0, 6), round(row[f"s{i}"] or 0.0, 6) or 1.0) for i in range(len(cards))}


def verdict(ensemble_auc: float, worker_aucs: list[float]) -> dict:
    """Lifts over the mean and the best worker; verified if the mean is reached."""
    best, mean = max(worker_aucs), round(sum(worker_aucs) / len(worker_aucs), 6)
    return {"auc": ensemble_auc, "best": best, "mean": mean, "lift_mean": round(ensemble_auc - mean, 6), "lift_best": round(ensemble_auc - best, 6), "verified": ensemble_auc >= mean, "beats_best": ensemble_auc >= best}


def addresses(n: int, space: int = 127) -> list[int]:
    return [k % space for k in range(n)]


def evolve(df: DataFrame, domain: str, features: list[str], generations: int = 6, population: int = 8, seed: int = 7, effort: Effort = VIEW, select_on: str = "held") -> dict:
    """Evolve feature subsets (two and more): a subset's fitness is the AUC of a card grown on it alone; the best never gets worse.

    select_on 'held' grades subsets on the held-out rows; 'validation' keeps those for the end.
    """
    r = Stream(seed * 2654435761 & 0xFFFFFFFF)
    known: dict[tuple[str, ...], float] = {}
    graded = df if select_on == "held" else with_inner(df, 0.25, seed).where("split = 'train'").withColumn("split", F.when(F.col("_inner") == "held", "held").otherwise("train")).drop("_inner")

    def fitness(subset: tuple[str, ...]) -> float:
        key = tuple(sorted(subset))
        if key not in known:
            known[key] = grow(graded, domain, list(key), seed, effort).held_auc
        return known[key]

    def vary(subset: tuple[str, ...]) -> tuple[str, ...]:
        out = list(subset)
        if r.coin() and len(out) < len(features):
            out.append(features[r.below(len(features))])
        elif len(out) > 2:
            out.pop(r.below(len(out)))
        out = list(dict.fromkeys(out))
        return tuple(out if len(out) >= 2 else features[:2])

    def join(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
        both = tuple(dict.fromkeys([x for x in a if r.coin()] + [x for x in b if r.coin()]))
        return both if len(both) >= 2 else tuple(dict.fromkeys(a + b))[: max(2, -(-(len(a) + len(b)) // 2))]

    pop = [tuple(features)]
    while len(pop) < population:
        shuffled = sorted(features, key=lambda _: r())
        pop.append(tuple(shuffled[: 2 + r.below(max(1, len(features) - 1))]))
    baseline = fitness(tuple(features))
    best, curve = (baseline, tuple(features)), []
    for _ in range(generations):
        scored = sorted(((fitness(s), s) for s in pop), key=lambda x: (-x[0], len(x[1])))
        top = scored[0]
        if (-top[0], len(top[1])) < (-best[0], len(best[1])):
            best = top
        curve.append(best[0])
        elites = [s for _, s in scored[: max(2, -(-population // 3))]]
        pop = elites[:]
        while len(pop) < population:
            a, b = elites[r.below(len(elites))], elites[r.below(len(elites))]
            pop.append(vary(join(a, b)) if r.coin() else vary(a))
    return {"baseline": baseline, "auc": best[0], "features": sorted(best[1]), "curve": curve, "lift": round(best[0] - baseline, 6), "improved": best[0] > baseline + 1e-9}
