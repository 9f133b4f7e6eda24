"""Choice of the latest game that holds data, per entity or per set of entities.

The choice is made on the relation as it is, before any filter on move properties:
filtering first would silently move an entity to an older game.

Everything is an aggregation with a map-side partial, never a window over the fact:
an entity that owns a third of the fact is combined where it lies, and only one row
per (entity, game) crosses the network. Games are few: they are broadcast, so that no join deals
the rows to one task per game.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def games_with_data(fact: DataFrame, keys: list[str], game: str, **flags: Column) -> DataFrame:
    """One row per (keys, game) with, for each flag, whether some fact row carries it."""
    aggregates = [F.max(F.coalesce(flag, F.lit(False))).alias(name) for name, flag in flags.items()]
    return fact.groupBy(*keys, game).agg(F.count(F.lit(1)).alias("fact_rows"), *aggregates)


def latest_game(
    fact: DataFrame,
    games: DataFrame,
    keys: list[str],
    *,
    game: str = "game_id",
    chronology: tuple[str, ...] = ("order", "generation_id", "game_id"),
    method: Column | None = None,
    strict_method: bool = False,
) -> DataFrame:
    """``keys`` plus the latest ``game`` of each key.

    With ``method``, the latest game where the key has that method; when it has none,
    the latest game overall, unless ``strict_method`` drops the key.
    """
    flags = {"has_method": method} if method is not None else {}
    per_game = games_with_data(fact, keys, game, **flags).join(F.broadcast(games), game)
    rank = F.struct(*[F.col(column) for column in chronology])
    latest = F.max_by(F.col(game), rank)
    if method is not None:
        with_method = F.max_by(F.col(game), F.when(F.col("has_method"), rank))
        latest = with_method if strict_method else F.coalesce(with_method, latest)
    chosen = per_game.groupBy(*keys).agg(latest.alias(game)) if keys else per_game.agg(latest.alias(game))
    return chosen.filter(F.col(game).isNotNull())


def matching_in_latest(
    fact: DataFrame,
    games: DataFrame,
    keys: list[str],
    predicate: Column,
    *,
    game: str = "game_id",
    chronology: tuple[str, ...] = ("order", "generation_id", "game_id"),
    method: Column | None = None,
) -> DataFrame:
    """Keys whose latest game holds one fact row that satisfies the whole predicate.

    The existence test travels with the choice of the game, so the fact is read once
    and never joined back to itself.
    """
    flags = {"hit": predicate}
    if method is not None:
        flags["has_method"] = method
    per_game = games_with_data(fact, keys, game, **flags).join(F.broadcast(games), game)
    rank = F.struct(*[F.col(column) for column in chronology])
    outcome = F.struct(F.col(game), F.col("hit"))
    chosen = F.max_by(outcome, rank)
    if method is not None:
        chosen = F.coalesce(F.max_by(outcome, F.when(F.col("has_method"), rank)), chosen)
    return (
        per_game.groupBy(*keys)
        .agg(chosen.alias("chosen"))
        .filter(F.col("chosen.hit"))
        .select(*keys, F.col(f"chosen.{game}").alias(game))
    )


def matching_in_game(fact: DataFrame, keys: list[str], predicate: Column) -> DataFrame:
    """Keys with one fact row satisfying the predicate, for a game fixed by the predicate."""
    return fact.filter(predicate).select(*keys).distinct()


def first_game_order(fact: DataFrame, games: DataFrame, keys: list[str], *, game: str = "game_id", order: str = "order") -> DataFrame:
    """Chronological position of the first game of each key."""
    present = fact.select(*keys, game).distinct().join(F.broadcast(games.select(game, order)), game)
    return present.groupBy(*keys).agg(F.min(order).alias("first_order"))


def missing_games_since_first(
    fact: DataFrame, games: DataFrame, keys: list[str], *, game: str = "game_id", order: str = "order"
) -> DataFrame:
    """Games without data after the first game of each key.

    The games of a key are gathered as a set (bounded by the number of games) and
    subtracted from the list of games: no (key, game) grid is built or shuffled.
    """
    listing = games.select(F.struct(F.col(order), F.col(game)).alias("g")).agg(F.array_sort(F.collect_set("g")).alias("listing"))
    per_key = (
        fact.groupBy(*keys, game).agg(F.count(F.lit(1)).alias("fact_rows"))
        .join(F.broadcast(games.select(game, order)), game)
        .groupBy(*keys)
        .agg(F.collect_set(game).alias("present"), F.min(order).alias("first_order"))
        .withColumn("listing", listing.scalar())
    )
    missing = F.filter(
        F.col("listing"),
        lambda g: (g[order] > F.col("first_order")) & ~F.array_contains(F.col("present"), g[game]),
    )
    return per_key.select(*keys, "first_order", F.explode(missing).alias("g")).select(
        *keys, "first_order", F.col(f"g.{game}").alias(game), F.col(f"g.{order}").alias(order)
    )
