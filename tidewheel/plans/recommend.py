"""The tables that most plans share, and the flagship plan from interactions to ranked lists."""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators import channels, clean, fusion, grouped, nearest, sequence, similarity, stats, training
from tidewheel.operators.shared import dealt, enough_parts, placed, stored
from tidewheel.sources.interactions import star_interactions

NEIGHBORS, BUDGET, HALF_LIFE = 30, 75, 90.0
WEIGHTS: Mapping[str, float] = {"cf": 2.0, "category": 0.7, "hot": 0.05}


class Tables:
    """Lazily built frames over one data folder. What several plans or several parts of a plan read is stored on first use; the others are plans.

    :func:`tables` gives the same set for the same session and folder, so a stored table is built once a session; the folder's tables must not change meanwhile.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def inter(self) -> DataFrame:
        return star_interactions(self.spark, self.sf_dir)

    @cached_property
    def parts(self) -> int:
        """Parts by user."""
        return enough_parts(self.spark, self.read("lineitem").count())

    @cached_property
    def ded(self) -> DataFrame:
        """Positive interactions, each (user, item) once, dealt out by user, as what follows wants them."""
        return clean.first_interactions(dealt(clean.positives(self.inter), "user_id", parts=self.parts)).select("user_id", "item_id", "ts", "rating", "category", "brand")

    @cached_property
    def fw(self) -> DataFrame:
        return placed(sequence.future_window(self.ded), "split", "user_id", self.parts)

    @cached_property
    def train(self) -> DataFrame:
        return self.fw.where("split = 'train'").select("user_id", "item_id", "ts", "rating", "category", "brand")

    @cached_property
    def targets(self) -> DataFrame:
        return self.fw.where("split = 'target'").select("user_id", "item_id")

    @cached_property
    def hist(self) -> DataFrame:
        """Histories of the users with targets: one scan with the split, not a join."""
        return self.fw.where("split = 'train' and eligible").select("user_id", "item_id", "ts", "rating", "category", "brand")

    @cached_property
    def hot(self) -> DataFrame:
        return stored(stats.popularity(self.train), "hot")

    @cached_property
    def dim(self) -> DataFrame:
        return self.read("part").selectExpr("p_partkey as item_id", "p_type as category", "p_brand as brand")

    @cached_property
    def sim(self) -> DataFrame:
        parts = similarity.similarity_parts(self.train)
        return placed(similarity.cosine_iuf(self.train, NEIGHBORS, parts=parts), "similar", "item_id", parts)

    @cached_property
    def known(self) -> DataFrame:
        """What may not be a negative of the users with targets: their histories and the targets themselves."""
        return self.fw.where("eligible").select("user_id", "item_id")

    def _channel(self, name: str) -> DataFrame:
        return self.lists.where(F.col("channel") == name).drop("channel")

    @cached_property
    def cf(self) -> DataFrame:
        """Topped up with popular items at score -1 before fusion, where these take ranks of their own."""
        return self._channel("cf")

    @cached_property
    def nearest(self) -> DataFrame:
        """Unseen items nearest to the mean vector of the last items that have one, stored by user as a row of lists each; ``embeddings`` are the items' vectors."""
        items = self.read("embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"))
        return placed(nearest.vector_lists(self.hist, items, BUDGET, self.parts), "vector", "user_id", self.parts)

    @cached_property
    def vector_rows(self) -> DataFrame:
        """The vector channel as :func:`fusion.gathered` takes it."""
        row = lambda x, at: F.struct(F.lit("vector").alias("channel"), x["ids"].alias("item_id"), x["scores"].alias("score"), (at + 1).cast("int").alias("rank"))
        return self.nearest.select("user_id", F.transform(F.arrays_zip("ids", "scores"), row).alias("rows"))

    @cached_property
    def vector(self) -> DataFrame:
        return self.vector_rows.select("user_id", F.inline("rows")).drop("channel")

    @cached_property
    def category(self) -> DataFrame:
        return self._channel("category")

    @cached_property
    def hot5(self) -> DataFrame:
        return self._channel("hot")

    @cached_property
    def inner(self) -> Tables:
        """The same tables within the training part: its last fifth is held out, so pools of it never saw those events."""
        t = Tables(self.spark, self.sf_dir)
        t.__dict__["ded"] = self.train
        return t

    @cached_property
    def training_pools(self) -> DataFrame:
        return training.training_pools(self.train, self.sim, self.dim, self.hot, {"cf": 2.0, "category": 0.7, "hot": 0.05}, BUDGET, 180.0, parts=self.parts)

    @cached_property
    def lists(self) -> DataFrame:
        """The item-item channel topped up, the category and the popular channel, and their pool, made where a user's events are."""
        return placed(grouped.user_channels(self.hist, self.sim, self.dim, self.hot, BUDGET, HALF_LIFE, WEIGHTS, parts=self.parts), "channels", "user_id", self.parts)

    @cached_property
    def stacked(self) -> DataFrame:
        return self.lists.where("channel <> 'pool'")

    @cached_property
    def pool(self) -> DataFrame:
        """Reciprocal rank fusion. It needs no refill: the item-item channel is topped up to the same budget, so a list is full or holds every unseen popular item."""
        return self._channel("pool")

    @cached_property
    def brand(self) -> DataFrame:
        return channels.brand(self.hist, self.dim, self.hot, self.hist, BUDGET, named=True, parts=self.parts)

    @cached_property
    def _topped(self) -> dict[float, DataFrame]:
        return {}

    def topped_cf(self, half_life: float) -> DataFrame:
        """The item-item channel with a half life, topped up; stored once for all recipes that share it."""
        if half_life == HALF_LIFE:
            return self.cf
        if half_life not in self._topped:
            raw = stored(channels.item_cf(self.hist, self.sim, self.hist, BUDGET, half_life), "item-cf")
            self._topped[half_life] = stored(channels.refill(raw, self.hist, self.hot, self.hist, BUDGET), "topped")
        return self._topped[half_life]

    def recipe(self, name: str) -> DataFrame:
        """The pool of a named recipe. The item-item channel has the recipe's half life and is topped up to the budget, so no pool needs a refill."""
        mode, half_life, brands = fusion.RECIPES[name]
        lists = {"cf": self.topped_cf(half_life), "vector": self.vector, "category": self.category, "hot": self.hot5}
        return fusion.fuse({**lists, **({"brand": self.brand} if brands else {})}, mode, fusion.RECIPE_WEIGHTS, BUDGET)

    @cached_property
    def four_channels(self) -> DataFrame:
        """The pool with the vector channel, at the default weights; as :attr:`pool`, it needs no refill."""
        stacked = fusion.gathered(self.hist.select("user_id").distinct(), self.stacked, self.vector_rows).select("user_id", F.inline("rows"))
        return fusion.rrf(stacked, fusion.DEFAULT_WEIGHTS, BUDGET, placed=True)


_KNOWN: WeakKeyDictionary[SparkSession, dict[str, Tables]] = WeakKeyDictionary()


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The folder's tables, the same for each call of a session."""
    own = _KNOWN.setdefault(spark, {})
    return own.setdefault(sf_dir, Tables(spark, sf_dir))


def recommend(spark: SparkSession, sf_dir: str, k: int = 5, recipe: str | None = None) -> DataFrame:
    """The first ``k`` items of every user: channels and fusion from the training part of the log, by the default plan or a named recipe of ``fusion.RECIPES``."""
    t = tables(spark, sf_dir)
    return (t.recipe(recipe) if recipe else t.pool).where(f"rank <= {int(k)}")
