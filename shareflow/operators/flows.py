"""Who moved: large changes, transfer pairs, patterns of a day's changes, largest holders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shareflow.functions.rules import contains_any
from shareflow.functions.scalars import is_participant_id, participant_name
from shareflow.operators.tables import first_rows, forward_filled, spread, top_rows

# Parts of names that look like brokers, and like custodians.
BROKER_WORDS = ["securities", "sec", "brokerage", "capital", "futu", "uob", "kingston", "rifa", "phillip", "bright"]
CUSTODY_WORDS = ["bank", "nominees", "custodian", "clearing", "hkscc", "central clearing"]

#: Names that change_patterns gives beside its flags, at most.
LARGE_NAMES, BROKER_NAMES = 3, 5

SERIES = ["code", "date"]


def filled_dates(big_changes: DataFrame, block: int | None = None) -> DataFrame:
    """Rows of a feed that prints each date once: blank dates take the one above; rows without a participant go.

    block: as forward_filled() takes it.
    """
    return forward_filled(big_changes, "date", ["code"], "seq", block).filter(F.trim("participant_name") != "")


def with_participant_ids(big_changes: DataFrame, holdings: DataFrame) -> DataFrame:
    """Add the id of the participant of that exact name in the holdings of the code; of several the highest ranked."""
    ids = first_rows(holdings.select("code", "participant_name", "participant_id", "rank", "date"), ["code", "participant_name"], [F.desc("date"), F.asc("rank")])
    return big_changes.join(ids.select("code", "participant_name", "participant_id"), ["code", "participant_name"], "left")


def transfer_pairs(big_changes: DataFrame, threshold: float = 10.0, tolerance: float = 2.0) -> DataFrame:
    """Pairs of one code and date in which one participant gained and another lost about as much, both at least threshold.

    A band join: magnitudes are cut into bands as wide as the tolerance; a gain meets the losses of its own band and of
    the two beside it, and only then is the difference looked at.
    """
    large = big_changes.filter(F.abs("change_pct") >= threshold)
    # a little wider than the tolerance, so that rounding never puts two magnitudes within it two bands apart
    width = tolerance * (1 + 1e-9) or 1e-9
    band = F.floor(F.abs("change_pct") / width)
    gain = large.filter("change_pct > 0").select(*SERIES, F.col("participant_name").alias("gained_by"), F.col("change_pct").alias("gain_pct"), F.explode(F.sequence(band - 1, band + 1)).alias("_band"))
    loss = large.filter("change_pct < 0").select(*SERIES, F.col("participant_name").alias("lost_by"), F.col("change_pct").alias("loss_pct"), band.alias("_band"))
    return gain.join(loss, [*SERIES, "_band"]).filter(F.abs(F.abs("gain_pct") - F.abs("loss_pct")) <= tolerance).drop("_band")


def major_moves(changes: DataFrame, k: int | None = 5) -> DataFrame:
    """The k largest increases and decreases of each snapshot, all for None; direction and move_rank tell them apart."""
    up = top_rows(changes.filter("change_shares > 0"), SERIES, [F.desc("change_shares"), F.asc("participant_id")], k, "move_rank")
    down = top_rows(changes.filter("change_shares < 0"), SERIES, [F.asc("change_shares"), F.asc("participant_id")], k, "move_rank")
    columns = [*SERIES, "move_rank", "participant_id", "participant_name", "change_shares"]
    return up.select(*columns, F.lit("increase").alias("direction")).unionByName(down.select(*columns, F.lit("decrease").alias("direction")))


def move_text(moves: DataFrame) -> DataFrame:
    """The `name: change` form of a move."""
    return moves.withColumn("text", F.concat_ws(": ", "participant_name", F.col("change_shares").cast("string")))


def split_move_text(texts: DataFrame) -> DataFrame:
    """Name and change of `name: change`, split at the last `: `."""
    return texts.withColumns({"name": F.regexp_extract("text", "^(.*): (.*)$", 1), "change": F.regexp_extract("text", "^(.*): (.*)$", 2)})


def change_patterns(changes: DataFrame) -> DataFrame:
    """Flags of each snapshot's changes against the date before.

    large_increase: someone who gained holds 1% or more; broker_increase: a broker-like name gained; single_seller: the
    largest decrease is at least half of all; spread_buying: four or more gained; transfer: `yes` if gains and losses
    differ by at most 15% of the larger, `possible` if a custodian gained while others lost, else `no`. Beside the flags,
    names in order of the change: the first LARGE_NAMES who gained and hold 1%, the first BROKER_NAMES brokers, and the
    seller (null if there is no single one). A name's place is counted along the sorted changes, so no group is collected.
    """
    name, change = F.lower("participant_name"), F.col("change_shares")
    up, down = change > 0, change < 0
    moved = spread(changes, *SERIES).withColumns(
        {
            "_large": up & (F.coalesce("bps_after", F.lit(0)) >= 10000),
            "_broker": up & contains_any(name, BROKER_WORDS),
            "_custody": up & contains_any(name, CUSTODY_WORDS),
        }
    )
    # places among large increases and among brokers, from the largest change down
    down_to = Window.partitionBy(*SERIES).orderBy(F.desc("change_shares"), F.asc("participant_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = moved.withColumns({f"{c}_no": F.count_if(c).over(down_to) for c in ("_large", "_broker")})
    named = lambda c, k: F.transform(F.array_sort(F.collect_list(F.when(F.col(c) & (F.col(f"{c}_no") <= k), F.struct(F.col(f"{c}_no").alias("no"), "participant_name")))), lambda x: x["participant_name"])
    total = lambda condition: F.sum(F.when(condition, F.abs(change)).otherwise(0))
    sums = moved.groupBy(*SERIES).agg(
        total(up).alias("gained"),
        total(down).alias("lost"),
        F.count_if(up).alias("n_increased"),
        F.count_if(down).alias("n_decreased"),
        F.count_if("_large").alias("n_large"),
        F.count_if("_broker").alias("n_broker"),
        F.count_if("_custody").alias("n_custody"),
        F.coalesce(F.max(F.when(down, -change)), F.lit(0)).alias("largest_loss"),
        named("_large", LARGE_NAMES).alias("large_names"),
        named("_broker", BROKER_NAMES).alias("broker_names"),
        F.min(F.when(down, F.struct("change_shares", "participant_id", "participant_name")))["participant_name"].alias("_seller"),
    )
    gap, larger = F.abs(F.col("gained") - F.col("lost")), F.greatest("gained", "lost")
    transfer = F.when((F.col("gained") > 0) & (F.col("lost") > 0) & (gap * 100 <= larger * 15), "yes").when((F.col("n_custody") > 0) & (F.col("lost") > 0), "possible").otherwise("no")
    single = (F.col("n_decreased") > 0) & (F.col("largest_loss") * 2 >= F.col("lost"))
    return sums.select(
        *SERIES,
        "gained",
        "lost",
        "n_increased",
        "n_decreased",
        (F.col("n_large") > 0).alias("large_increase"),
        (F.col("n_broker") > 0).alias("broker_increase"),
        single.alias("single_seller"),
        (F.col("n_increased") >= 4).alias("spread_buying"),
        transfer.alias("transfer"),
        "large_names",
        "broker_names",
        F.when(single, F.col("_seller")).alias("seller_name"),
    )


def largest_participant(ranked: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """The first holder with a valid id of each code's rows; codes without one take the largest holding of fallback."""
    valid = ranked.filter(is_participant_id(F.col("participant_id")))
    first = first_rows(valid, ["code"], [F.desc("date"), F.asc("rank")]).select("code", "date", "participant_id", participant_name(F.col("participant_name")).alias("participant_name"), "bps")
    if fallback is None:
        return first
    other = first_rows(fallback, ["code"], [F.desc("date"), F.desc("shares"), F.asc("participant_id")])
    other = other.select("code", "date", "participant_id", participant_name(F.col("participant_name")).alias("participant_name"), "bps").join(first.select("code"), "code", "left_anti")
    return first.unionByName(other)


def biggest_move(changes: DataFrame, magnitude: str, order: list[str]) -> DataFrame:
    """The row of the greatest magnitude of each code, the first in order among equals."""
    return first_rows(changes.filter(F.col(magnitude).isNotNull()), ["code"], [F.desc(F.abs(magnitude)), *(F.asc(c) for c in order)])
