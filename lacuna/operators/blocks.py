"""Filling by blocks: from a seed outwards, chained or expanding."""

from __future__ import annotations

import datetime
import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import panel as panels
from .forest import InitialisedForest, IterativeForest, IterativeForestModel, Settings


def window_days(years: int) -> int:
    return 365 * years + years // 4


@dataclass(frozen=True)
class Block:
    #: 1 is next to the seed
    step: int
    direction: str
    start: datetime.date
    end: datetime.date


def plan(first: datetime.date, last: datetime.date, seed_start: datetime.date, seed_end: datetime.date, days: int) -> list[Block]:
    """Blocks on both sides of the seed, of ``days`` + 1 days, the outermost cut at the ends of the data."""
    day, out = datetime.timedelta(1), []
    start, step = seed_start, 0
    while start > first:
        step, end = step + 1, start - day
        start = max(end - days * day, first)
        out.append(Block(step, "backward", start, end))
    end, step = seed_end, 0
    while end < last:
        step, begin = step + 1, end + day
        end = min(begin + days * day, last)
        out.append(Block(step, "forward", begin, end))
    return out


def plan_table(panel: DataFrame, seed: DataFrame, days: int) -> DataFrame:
    """The same plan as a query: ``seed`` has start_date, end_date. Columns: direction, step, start_date, end_date."""
    ends = panel.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    both = seed.select("start_date", "end_date").crossJoin(ends)  # one row each
    size = days + 1
    count = lambda gap: F.when(gap > 0, F.sequence(F.lit(1), F.ceil(gap / size).cast("int")))
    back = both.select("*", F.explode(count(F.datediff("start_date", "first"))).alias("step"))
    back = back.select(F.lit("backward").alias("direction"), "step", F.greatest(F.expr(f"date_sub(start_date, step * {size})"), "first").alias("s"), F.expr(f"date_sub(start_date, (step - 1) * {size} + 1)").alias("e"))
    ahead = both.select("*", F.explode(count(F.datediff("last", "end_date"))).alias("step"))
    ahead = ahead.select(F.lit("forward").alias("direction"), "step", F.expr(f"date_add(end_date, (step - 1) * {size} + 1)").alias("s"), F.least(F.expr(f"date_add(end_date, step * {size})"), "last").alias("e"))
    return back.unionByName(ahead).select("direction", "step", F.col("s").alias("start_date"), F.col("e").alias("end_date"))


def _as_panel(filled: DataFrame) -> DataFrame:
    return filled.select("station", "date", "dn", F.col("filled").alias("value"))


def _ends(panel: DataFrame) -> tuple[datetime.date, datetime.date]:
    row = panel.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    return row["a"], row["b"]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def forest(settings: Settings) -> InitialisedForest:
    return InitialisedForest(settings)


def seed_model(panel: DataFrame, start, end, settings: Settings) -> IterativeForestModel:
    """The model of a block, fitted once a run; with a ``cache`` folder, once for all runs of equal settings and readings."""
    block = panels.between(panel, start, end)
    return settings.once(f"seed {start} {end}", lambda: fit_cached(forest(settings), block, settings.cache) if settings.cache else forest(settings).fit(block))


def seed_filled(panel: DataFrame, start, end, settings: Settings) -> DataFrame:
    """The block itself, filled by its model once a run."""
    return settings.once(f"filled {start} {end}", lambda: seed_model(panel, start, end, settings).transform(panels.between(panel, start, end)))


def seed_only(panel: DataFrame, start, end, settings: Settings) -> DataFrame:
    """Fit on the seed block, fill all days outside of it."""
    return seed_model(panel, start, end, settings).transform(panels.outside(panel, start, end))


def chaining(panel: DataFrame, start, end, years: int, settings: Settings) -> DataFrame:
    """Each block is filled by a model of only the block before it, first backward, then forward from the seed again."""
    first, last = _ends(panel)
    of_seed = seed_model(panel, start, end, settings)
    out = [seed_filled(panel, start, end, settings)]
    blocks = plan(first, last, start, end, window_days(years))
    for direction in ("backward", "forward"):
        model, own = of_seed, [b for b in blocks if b.direction == direction]
        for k, b in enumerate(own):
            part = panels.between(panel, b.start, b.end)
            if part.isEmpty():
                break
            out.append(model.transform(part))
            if k + 1 < len(own):
                model = forest(settings).fit(_as_panel(out[-1]))
    return _union(out)


def expanding(panel: DataFrame, start, end, years: int, settings: Settings) -> DataFrame:
    """Each round fits one model on everything filled so far and fills a block on either side."""
    first, last = _ends(panel)
    out = [seed_filled(panel, start, end, settings)]
    blocks = plan(first, last, start, end, window_days(years))
    for step in range(1, max((b.step for b in blocks), default=0) + 1):
        fit = lambda: forest(settings).fit(_as_panel(_union(out)))
        model = settings.once(f"expanded {start} {end}", fit) if step == 1 else fit()  # the first round knows the seed alone
        new = [p for b in blocks if b.step == step and not (p := panels.between(panel, b.start, b.end)).isEmpty()]
        if not new:
            break
        out += [model.transform(p) for p in new]
    return _union(out)


def seed_and_fill(panel: DataFrame, start, end, days: int, settings: Settings) -> DataFrame:
    """The target range filled by a model of its best window, which was filled by a model of its own first."""
    target = panels.between(panel, start, end)
    seed_start, seed_end = panels.find_best_window(target, start, end, days)
    seed = panels.between(target, seed_start, seed_end)
    model = forest(settings).fit(_as_panel(forest(settings).fit(seed).transform(seed)))
    return model.transform(target)


def rolling(panel: DataFrame, first_year: int, last_year: int, years: int, min_percent: float, settings: Settings) -> DataFrame:
    """The most complete run of whole years is the seed, and blocks of as many years expand from it."""
    part = panels.between(panel, f"{first_year}-01-01", f"{last_year}-12-31")
    best = panels.year_completeness(part, years, min_percent).orderBy(F.desc("percent"), "first_year").first()
    if best is None:
        raise ValueError(f"no {years} years have {min_percent} % of their readings")
    return expanding(part, datetime.date(best["first_year"], 1, 1), datetime.date(best["last_year"], 12, 31), years, settings)


def fit_cached(parent: IterativeForest, panel: DataFrame, folder: str) -> IterativeForestModel:
    """Fit, or load what an equal fit saved: equal kind, settings and readings."""
    s = parent.settings
    plain = {k: v for k, v in vars(s).items() if k not in ("distances", "connectivity", "weights", "fits", "parallelism", "cache")}
    tables = [t for t in (s.distances, s.connectivity) if t is not None] + [panel.select("station", "date", "value")]
    sums = [t.agg(F.count("*"), F.sum(F.xxhash64(*t.columns) % 1_000_000_007)).first() for t in tables]
    path = f"{folder}/{hashlib.md5(repr((type(parent).__name__, sorted(plain.items()), [tuple(x) for x in sums])).encode()).hexdigest()}"
    try:
        return IterativeForestModel.load(path)
    except AnalysisException:  # nothing was saved there
        model = parent.fit(panel)
        model.write().overwrite().save(path)
        return model
