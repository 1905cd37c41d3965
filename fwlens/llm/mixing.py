"""Mixing sources to target weights: hierarchical budgeting over a tree domain > language > source.

Weights go down the tree; a child that holds fewer tokens than its share (over all allowed epochs) keeps what it holds,
and its shortage goes to its siblings by their weights; only what they cannot take goes to siblings of their parent. Each
leaf then reads seeded epochs: whole ones, and of the last one the documents that start before the budget is used up.

The tree has one entry per leaf and is weighed on the driver. Places in the order of an epoch come from token sums of
hash ranges, about as many ranges as the square root of a leaf's documents, so that no leaf is sorted or summed whole.
DataFrame functions only.

Cases: null languages and sources are leaves named ``unknown``; documents without words hold no tokens and are never
drawn; :func:`draw` names rows by their ids, so that rows with one id, or none, stand next to each other and cannot be
told apart, while :func:`drawn_documents` tells rows apart by all their columns, and equal rows are drawn together; an
empty table gives an empty result; other columns are not read by :func:`draw` and pass through :func:`drawn_documents`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from fwlens.llm.row_keys import row_keyed
from fwlens.llm.storage import stored

LEAF = ("domain", "lang", "source")


@dataclass(frozen=True)
class MixPlan:
    """Weights by path, e.g. ``("news",)`` or ``("news", "en")``; siblings without an entry weigh ``other_weight``.

    ``budget_percent`` of all tokens are drawn, at most ``epochs`` times each.
    """

    weights: dict[tuple[str, ...], float] = field(default_factory=dict)
    domains: dict[str, str] = field(default_factory=dict)
    other_domain: str = "other"
    other_weight: float = 1.0
    budget_percent: int = 50
    epochs: int = 2
    seed: int = 17


#: Production plan of the registered queries.
PLAN = MixPlan(
    weights={
        ("crawl",): 5.0, ("news",): 3.0, ("reference",): 2.0,
        **{(d, lang): w for d in ("crawl", "news", "reference") for lang, w in (("en", 6.0), ("de", 1.5), ("fr", 1.5), ("es", 1.0))},
    },
    domains={f"src{i}": "crawl" if i < 8 else "news" if i < 14 else "reference" for i in range(20)},
)


def shared(amount: int, weights: list[float], room: list[int]) -> list[int]:
    """Splits an amount by weights; what a full child cannot take goes to its siblings by their weights."""
    given = [0] * len(weights)
    open_ = [i for i in range(len(weights)) if room[i] > 0 and weights[i] > 0]
    left = min(amount, sum(room[i] for i in open_))
    while left and open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] >= (room[i] - given[i]) * total]
        if full:
            for i in full:
                left -= room[i] - given[i]
                given[i] = room[i]
            open_ = [i for i in open_ if i not in set(full)]
            continue
        parts = {i: int(left * weights[i] / total) for i in open_}
        rest = left - sum(parts.values())
        for i in open_:
            extra = min(1 if rest > 0 else 0, room[i] - given[i] - parts[i])
            rest -= extra
            given[i] += parts[i] + extra
        left = 0
    return given


def budgets(tokens: dict[tuple[str, ...], int], plan: MixPlan, amount: int) -> dict[tuple[str, ...], int]:
    """Token budget of each leaf path."""
    children: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for leaf in sorted(tokens):
        for depth in range(len(leaf)):
            below = children.setdefault(leaf[:depth], [])
            if not below or below[-1] != leaf[: depth + 1]:
                below.append(leaf[: depth + 1])
    weight = lambda path: plan.weights.get(path, plan.other_weight)
    room = {leaf: plan.epochs * n for leaf, n in tokens.items()}
    for path in sorted(children, key=len, reverse=True):
        # a branch takes what those below it can be given; without weight they are given nothing
        room[path] = sum(room[child] for child in children[path] if weight(child) > 0)
    found: dict[tuple[str, ...], int] = {}

    def descend(path: tuple[str, ...], given: int) -> None:
        if path in tokens:
            found[path] = given
            return
        below = children[path]
        for child, part in zip(below, shared(given, [weight(c) for c in below], [room[c] for c in below])):
            descend(child, part)

    if tokens:
        descend((), amount)
    return found


def token_count(text: Column) -> Column:
    """Words of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def _domain(source: Column, plan: MixPlan) -> Column:
    if not plan.domains:
        return F.lit(plan.other_domain)
    table = F.create_map(*[F.lit(x) for pair in sorted(plan.domains.items()) for x in pair])
    return F.coalesce(F.element_at(table, source), F.lit(plan.other_domain))


def draw(documents: DataFrame, plan: MixPlan = PLAN) -> DataFrame:
    """doc_id, domain, lang, source, epoch, epoch_start, n_tokens, used_tokens: one row per drawn document and epoch.

    ``used_tokens`` counts those inside the budget; they add up to it exactly."""
    spark = documents.sparkSession
    source = F.coalesce("source", F.lit("unknown"))
    rows = stored(
        documents.select(
            "doc_id", _domain(source, plan).alias("domain"), F.coalesce("lang", F.lit("unknown")).alias("lang"),
            source.alias("source"), token_count(F.col("text")).alias("n_tokens"),
        ).where("n_tokens > 0")
    )
    # one row per leaf of the tree
    sums = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()
    tokens = {tuple(row[c] for c in LEAF): row["tokens"] for row in sums}
    given = budgets(tokens, plan, sum(tokens.values()) * plan.budget_percent // 100) if tokens else {}
    sizes = {tuple(row[c] for c in LEAF): row["n"] for row in sums}
    table = [
        (*leaf, i, given[leaf] // tokens[leaf], given[leaf] % tokens[leaf], max(1, int(sizes[leaf] ** 0.5)))
        for i, leaf in enumerate(sorted(tokens))
    ]
    leaves = spark.createDataFrame(table, "domain string, lang string, source string, leaf int, whole bigint, rest bigint, ranges bigint")
    marked = rows.join(leaves, list(LEAF))
    last = F.when(F.col("rest") > 0, F.col("whole")).otherwise(F.col("whole") - 1)
    epochs = F.when(last >= 0, F.sequence(F.lit(0).cast("bigint"), last))
    spread = marked.withColumn("epoch", F.explode(epochs))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(plan.seed), "epoch", "doc_id"), 1)
    columns = ["doc_id", *LEAF, "epoch", "epoch_start", "n_tokens", "used_tokens"]
    spread = spread.withColumn("place", place).withColumn("range_no", F.floor(F.col("place") / 2.0**63 * F.col("ranges")))
    ranges = spread.groupBy("leaf", "epoch", "range_no").agg(F.sum("n_tokens").alias("range_tokens"))
    before = Window.partitionBy("leaf", "epoch").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("leaf", "epoch", "range_no", F.coalesce(F.sum("range_tokens").over(before), F.lit(0)).alias("range_start"))
    joined = spread.join(starts, ["leaf", "epoch", "range_no"])
    needed = joined.where((F.col("epoch") < F.col("whole")) | (F.col("range_start") < F.col("rest")))
    inside = Window.partitionBy("leaf", "epoch", "range_no").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    ordered = needed.withColumn("epoch_start", F.col("range_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    taken = ordered.where((F.col("epoch") < F.col("whole")) | (F.col("epoch_start") < F.col("rest")))
    used = F.when(F.col("epoch") < F.col("whole"), F.col("n_tokens")).otherwise(F.least("n_tokens", F.col("rest") - F.col("epoch_start")))
    return taken.withColumn("used_tokens", used).select(*columns)


def drawn_documents(documents: DataFrame, plan: MixPlan = PLAN) -> DataFrame:
    """Documents that a plan draws, each once and whole, with all their columns."""
    keyed, key = row_keyed(documents, documents.columns)
    chosen = draw(keyed.select(F.col(key).alias("doc_id"), "lang", "source", "text"), plan)
    return keyed.join(chosen.select(F.col("doc_id").alias(key)).distinct(), key, "left_semi").drop(key)
