"""Mixtures of sources by temperature: weights from exponentiated token shares, realised as block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowmill.llm.staging import free_name

#: Exponents that are searched, and halvings of the interval.
LOWEST, HIGHEST, STEPS = 0.0, 16.0, 80
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mixture:
    exponent: float
    budget: float
    weights: dict  # by source
    tokens: dict  # by source

    def repeats(self, source) -> float:
        return self.budget * self.weights[source] / self.tokens[source]

    def entropy(self) -> float:
        return -sum(w * math.log(w) for w in self.weights.values() if w > 0)


def _weights(tokens: dict, exponent: float) -> dict:
    most = max(tokens.values())
    raw = {s: (n / most) ** exponent for s, n in tokens.items()}
    total = math.fsum(raw.values())
    return {s: x / total for s, x in raw.items()}


def mixture(tokens: dict, budget: float | None = None, entropy: float | None = None, max_repeats: float | None = None) -> Mixture:
    """Weights in proportion to (token share) ** exponent, the exponent found by bisection.

    ``entropy`` (share of the largest possible, 0 to 1): the exponent whose weights have this entropy. ``max_repeats``:
    the smallest exponent, so the flattest mixture, that repeats no source more often. One of both is to be given.
    ``budget`` is the number of tokens of the mixture; by default it is what one pass over the largest source makes
    of it, so that every document is used. Sources without tokens are left out. A limit that no exponent meets
    (fewer repeats than the budget needs) is an error.
    """
    if (entropy is None) == (max_repeats is None):
        raise ValueError("give a target entropy or a repetition limit")
    tokens = {s: n for s, n in tokens.items() if n > 0}
    if not tokens:
        return Mixture(1.0, 0.0, {}, {})
    largest = max(tokens, key=lambda s: tokens[s])

    def at(exponent):
        weights = _weights(tokens, exponent)
        return Mixture(exponent, tokens[largest] / weights[largest] if budget is None else budget, weights, tokens)

    def flat_enough(m):  # the mixture is at least as flat as wanted
        if entropy is not None:
            return m.entropy() >= entropy * math.log(len(tokens))
        return max(m.repeats(s) for s in tokens) > max_repeats

    if len(tokens) == 1 or (max_repeats is not None and not flat_enough(at(LOWEST))):
        return at(LOWEST)
    if max_repeats is not None and flat_enough(at(1.0)) and max(at(1.0).repeats(s) for s in tokens) > max_repeats * (1 + 1e-9):
        raise ValueError("the budget needs more repeats than the limit")
    low, high = LOWEST, 1.0 if max_repeats is not None else HIGHEST
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (middle, high) if flat_enough(at(middle)) else (low, middle)
    return at(high if max_repeats is not None else low)


def count_tokens(text: Column) -> Column:
    """Words of a text; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(df: DataFrame, entropy: float | None = None, max_repeats: float | None = None, budget_share: float | None = None,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> tuple[DataFrame, Mixture]:
    """Rows of the mixture with n_tokens, weight, pass and position, and the mixture.

    ``budget_share`` gives the budget as a share of all tokens (None: one pass over the largest source). Each source
    is read in passes until its part of the budget is used: documents fall into blocks by a hash, about as many
    blocks as each has documents; in every pass a source's blocks come in another permutation and the documents of
    a block in the order of a hash. A document is taken while the tokens before it are fewer than the source's
    part (a whole number), and in the first pass over a source whose part covers its tokens always, also without words. ``position`` (0 to 1) is that number over the part, so ordering by it interleaves the sources, and each
    beginning of the order has the target weights.

    Sums of tokens per source come to the driver (one row per source); per block they are summed by Spark. A null
    source is a source of its own. Documents of sources without tokens are taken once, at position 0 with weight 0.
    Equal rows are documents of their own, in the order of their id and text. Added columns replace columns of
    the same name.
    """
    added = {"n_tokens", "weight", "pass", "position"}
    kept = [c for c in df.columns if c.lower() not in added]
    name = {k: free_name(df, f"_{k}") for k in ("n", "src", "block", "order", "inner", "of", "in", "held", "part", "share", "turn", "begin", "load")}
    docs = df.withColumn(name["n"], count_tokens(F.col(text_col)))
    # a key without nulls: a null source gets a name that no other source has
    docs = docs.withColumn(name["src"], F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-")))
    sums = docs.groupBy(name["src"]).agg(F.sum(name["n"]).alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()
    tokens = {r[0]: r["tokens"] for r in sums}
    total = sum(tokens.values())
    plan = mixture(tokens, None if budget_share is None else budget_share * total, entropy, max_repeats) if total else Mixture(1.0, 0.0, {}, {})
    blocks = max(1, math.isqrt(sum(r["docs"] for r in sums)))
    parts = [(s, n, plan.weights.get(s, 0.0), round(plan.budget * plan.weights.get(s, 0.0))) for s, n in tokens.items()]
    parts = df.sparkSession.createDataFrame(parts, f"{name['of']} string, {name['held']} long, {name['share']} double, {name['part']} long")
    col = {k: F.col(v) for k, v in name.items()}
    whole = (col["turn"] == 0) & (col["part"] >= col["held"])  # the first pass over a source whose part covers it takes everything

    row = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    docs = docs.withColumns({name["block"]: F.pmod(F.xxhash64(row), F.lit(blocks)).cast("int"), name["order"]: row})
    loads = docs.groupBy(col["src"].alias(name["of"]), col["block"].alias(name["in"])).agg(F.sum(name["n"]).alias(name["load"]))
    passes = F.greatest(F.ceil(col["part"] / F.greatest(col["held"], F.lit(1))) - 1, F.lit(0)).cast("int")
    loads = loads.join(F.broadcast(parts), name["of"]).withColumn(name["turn"], F.explode(F.sequence(F.lit(0), passes)))  # one row per source
    turn = Window.partitionBy(name["of"], name["turn"]).orderBy(F.xxhash64(F.lit(seed), name["of"], name["in"], name["turn"]), name["in"])
    before = F.sum(name["load"]).over(turn.rowsBetween(Window.unboundedPreceding, -1))
    loads = loads.withColumn(name["begin"], F.coalesce(before, F.lit(0)) + col["turn"] * col["held"]).drop(name["load"])
    loads = loads.where((col["begin"] < col["part"]) | whole)

    inside = Window.partitionBy(name["src"], name["block"]).orderBy(name["order"], id_col)
    docs = docs.withColumn(name["inner"], F.coalesce(F.sum(name["n"]).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = col["begin"] + col["inner"]
    out = docs.join(loads, (col["src"] == col["of"]) & (col["block"] == col["in"])).where((place < col["part"]) | whole)
    return out.select(*[F.col(f"`{c}`") for c in kept], col["n"].alias("n_tokens"), col["share"].alias("weight"), col["turn"].alias("pass"),
                      F.when(col["part"] == 0, F.lit(0.0)).otherwise(place / col["part"]).alias("position")), plan
