"""Connected components of billions of links, by low-diameter decomposition.

In each level every vertex draws an exponentially shifted start time. Clusters grow
from the vertices by one hop a round, and a vertex belongs to the cluster that reaches it
first: the one whose start time plus distance is least, its own included. Growth ends when no
vertex is reached earlier any more, which is after as many rounds as the largest cluster's radius: O(log n / RATE), and
never more than the component's diameter. A link lies between two clusters with probability RATE at most. Then clusters
contract to super-vertices, links inside them vanish, and the next level works on
the links between them until there are none; the assignments of all levels compose.
Every level works on DataFrames alone; what the driver sees is one number a round.

In a round only vertices that were reached earlier in the last one make offers. Rows of a key that very many share (links of a hub,
members of a giant component) are spread over several tasks: they get a salt by
their other column, and what is looked up for the key is repeated once a salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesim.session import checkpointed, forget

RATE = 0.3  # of the exponential shifts: slower ones cut fewer links, and take more rounds
HUB = 50_000  # rows of one key that a task may hold
HUBS = 100_000  # keys with more rows than that which are sent to every task; more are joined by a shuffle


def _hot(rows: DataFrame, key: str, hub: int) -> DataFrame:
    """``key, salts`` of the keys with more than ``hub`` rows, which are counted: they are broadcast only if they are few."""
    hot = checkpointed(rows.groupBy(key).agg(F.ceil(F.count("*") / hub).cast("int").alias("salts")).where("salts > 1"))
    return F.broadcast(hot) if hot.count() <= HUBS else hot


def _salted(rows: DataFrame, key: str, by: str | Column, hot: DataFrame) -> DataFrame:
    return rows.join(hot, key, "left").withColumn("salt", F.pmod(F.hash(by), F.coalesce("salts", F.lit(1)))).drop("salts")


def _repeated(table: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """A table of one row a key, once for each salt of the key."""
    return table.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


def _looked_up(rows: DataFrame, key: str, by: str, table: DataFrame, hub: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (one row a key), hot keys salted by the column ``by``."""
    hot = _hot(rows, key, hub)
    return _salted(rows, key, by, hot).join(_repeated(table, key, hot).hint("merge"), [key, "salt"], how).drop("salt")


def _grow(pairs: DataFrame, level: int, rate: float, rounds: int | None, hub: int) -> DataFrame:
    """``v, cluster`` for each vertex of the links (given in both directions)."""
    # uniform in (0, 1) from the vertex and the level: recomputed tasks draw the same
    unit = (F.pmod(F.xxhash64("v", F.lit(level)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    hot = _hot(pairs, "a", hub)
    links = checkpointed(_salted(pairs, "a", "b", hot))
    # start times count back from the largest shift there can be
    start = F.struct((F.lit(40.0 / rate) + F.log(unit) / rate).alias("at"), F.col("v").alias("cluster"))
    state = checkpointed(pairs.select(F.col("a").alias("v")).distinct().select("v", start.alias("mine"), F.lit(True).alias("early")))
    done = 0
    while rounds is None or done < rounds:
        known = _repeated(state.where("early").select(F.col("v").alias("a"), "mine"), "a", hot)
        offers = links.join(known.hint("merge"), ["a", "salt"]).groupBy(F.col("b").alias("v")).agg(F.min(F.struct((F.col("mine.at") + 1).alias("at"), F.col("mine.cluster").alias("cluster"))).alias("offer"))
        better = F.coalesce(F.col("offer") < F.col("mine"), F.lit(False))
        grown = checkpointed(state.select("v", "mine").join(offers.hint("merge"), "v", "left").select("v", F.when(better, F.col("offer")).otherwise(F.col("mine")).alias("mine"), better.alias("early")))
        forget(state)
        state = grown
        done += 1
        if state.where("early").isEmpty():
            break
    clusters = checkpointed(state.select("v", F.col("mine.cluster").alias("cluster")))
    forget(state, links)
    return clusters


def components(links: DataFrame, a: str, b: str, rate: float = RATE, rounds: int | None = None, hub: int = HUB) -> DataFrame:
    """``id, group_id`` for each id in at least one link: group_id is the smallest id it is linked to, directly or through others.

    Links are taken as undirected; repeated links, links with a null side and links of an id
    with itself change nothing (an id with no other link is in no row). Ids of any
    comparable type; no links give no rows. ``rounds`` ends the growth of a level early, which costs levels,
    not results, as a cluster never leaves its component.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    pairs = checkpointed(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    spark, kind = links.sparkSession, pairs.schema["a"].dataType.simpleString()
    maps: list[DataFrame] = []
    while not pairs.isEmpty():
        clusters = _grow(pairs, len(maps), rate, rounds, hub)
        maps.append(clusters)
        # each side in its turn; what is left of a hub's links after the first is one row a cluster
        half = _looked_up(pairs, "a", "b", clusters.select(F.col("v").alias("a"), F.col("cluster").alias("ca")), hub).select("ca", "b").distinct()
        half = checkpointed(half)
        left = _looked_up(half, "b", "ca", clusters.select(F.col("v").alias("b"), F.col("cluster").alias("cb")), hub).where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
        left = checkpointed(left)
        forget(pairs, half)
        pairs = left
    if not maps:
        return spark.createDataFrame([], f"id {kind}, group_id {kind}")
    whole = maps[-1]
    for m in reversed(maps[:-1]):  # a cluster that has no links left is a component
        up = whole.select(F.col("v").alias("cluster"), F.col("cluster").alias("root"))
        whole = checkpointed(_looked_up(m, "cluster", "v", up, hub, "left").select("v", F.coalesce("root", "cluster").alias("cluster")))
    names = whole.groupBy("cluster").agg(F.min("v").alias("group_id"))  # components are named by their smallest id
    return _looked_up(whole, "cluster", "v", names, hub).select(F.col("v").alias("id"), "group_id")


def linked_submissions(results: DataFrame, least: str = "0.80") -> DataFrame:
    """``submission_id, group_id`` of submissions linked by rows with score >= least. Ids trimmed, in lower case."""
    side = lambda c: F.lower(F.trim(c))
    links = results.where(F.col("score") >= F.lit(least).cast("decimal(5,2)")).select(side("left_submission_id").alias("a"), side("right_submission_id").alias("b"))
    return components(links, "a", "b").select(F.col("id").alias("submission_id"), "group_id")
