"""Reuse of earlier results: fingerprints, lookups and the stored table.

A file's fingerprint covers its path, time, size, content and the settings, so
a stored result is valid exactly when its fingerprint is met again.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tokens import HEURISTIC
from ..options import JobOptions
from ..scale import small_side, stored
from . import sieve

KEY = ["project", "rel_path"]
# Stored results: one table, or several of one layout.
Stored = DataFrame | Sequence[DataFrame]


def settings_fingerprint(
    depth: Column, tests: Column, resources: Column, sanitize: Column, mask: Column, minify: Column
) -> Column:
    """Column form of ``JobOptions.config_fingerprint`` without masked names."""
    flags = [F.when(c, "true").otherwise("false") for c in (tests, resources, sanitize, mask, minify)]
    listed = F.concat_ws(", ", F.concat(F.lit('"'), depth, F.lit('"')), *flags)
    return F.md5(F.concat(F.lit("["), listed, F.lit("]")))


def file_fingerprint(
    project: Column, rel_path: Column, mtime: Column, length: Column, config_hash: Column,
    digest: Column | None = None,
) -> Column:
    """SHA-256 over a file's identity, state and settings.

    ``digest`` is the SHA-256 of the text.  Without it a lookup never reads the
    content column, at the price of trusting time and size.
    """
    parts = [project, rel_path, F.coalesce(F.unix_micros(mtime), F.lit(0)), length, config_hash]
    if digest is not None:
        parts.append(digest)
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def with_fingerprint(files: DataFrame, options: JobOptions, digest: str = "content") -> DataFrame:
    """Add ``fingerprint``; ``digest="stat"`` leaves the content out of it."""
    if digest not in ("content", "stat"):
        raise ValueError(f"unknown digest {digest!r}")
    names = set(files.columns)
    return files.withColumn(
        "fingerprint",
        file_fingerprint(
            F.col("project"), F.col("rel_path"),
            F.col("mtime") if "mtime" in names else F.lit(None).cast("timestamp"),
            F.col("length") if "length" in names else F.octet_length("content"),
            F.lit(options.config_fingerprint()),
            F.sha2("content", 256) if digest == "content" else None,
        ),
    )


def _order() -> Column:
    return F.struct("created_at", "n_tokens")


def _best(cache: DataFrame) -> DataFrame:
    """Per fingerprint, what its last written row is known by; stored.

    Ranks keys alone: the text column is not read.  ``copies`` tells how many
    rows share that rank.
    """
    ranks = cache.groupBy("fingerprint", _order().alias("_order")).agg(F.count("*").alias("copies"))
    best = ranks.groupBy("fingerprint").agg(F.max(F.struct("_order", "copies")).alias("_best"))
    return stored(best.select(F.col("fingerprint").alias("_wanted"), "_best._order", "_best.copies"))


def _tables(cache: Stored) -> list[DataFrame]:
    return [cache] if isinstance(cache, DataFrame) else list(cache)


def _whole(cache: Stored) -> DataFrame:
    return reduce(DataFrame.unionByName, _tables(cache))


def _fetched(
    cache: Stored, best: DataFrame, keep: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``keep`` of the rows that ``best`` names.

    The keys are hashed and the rows streamed past them, so no text is sorted,
    nor moved where the tables are bucketed; each is looked up by itself, as their
    union would have no buckets.  Only rows that share a rank are ordered by
    their text, as nothing else tells them apart.
    """
    # None ranks above the best; said this way, the join's key stays that of the buckets.
    same = (F.col("fingerprint") == F.col("_wanted")) & (_order() >= F.col("_order"))
    found = [(t.columns, t.join(best.hint("shuffle_hash"), same)) for t in _tables(cache)]
    if best.where("copies > 1").isEmpty():
        return reduce(DataFrame.unionByName, [keep(f.select(*columns)) for columns, f in found])
    alone = [keep(f.where("copies = 1").select(*columns)) for columns, f in found]
    place = F.row_number().over(Window.partitionBy("fingerprint").orderBy("content"))
    # Written down: a union of joins claims their partitioning, and then a window
    # over it may see a fingerprint's rows in several tasks.
    tied = stored(reduce(DataFrame.unionByName, [f.where("copies > 1").select(*columns) for columns, f in found]))
    first = tied.withColumn("_place", place).where("_place = 1").drop("_place")
    return reduce(DataFrame.unionByName, [*alone, keep(first)])


def newest(cache: Stored) -> DataFrame:
    """The last written row per fingerprint.  Runs a job over the keys."""
    return _fetched(cache, _best(_whole(cache)), lambda rows: rows)


def hits(keys: DataFrame, cache: Stored) -> DataFrame:
    """Files whose result is stored, with that content and token count.

    Only the keys of the files take part, never their raw text, and of the
    stored rows only those asked for are ranked.  Runs a job over the keys.
    """
    asked = _whole(cache).join(keys.select("fingerprint"), "fingerprint", "left_semi")
    files = keys.drop("content", "n_tokens").hint("shuffle_hash")
    return _fetched(
        cache, _best(asked), lambda rows: files.join(rows.select("fingerprint", "content", "n_tokens"), "fingerprint")
    )


def _sifted(files: DataFrame, cache: Stored) -> DataFrame:
    """Add ``_maybe``: false where a file certainly has no stored result."""
    return sieve.with_maybe(files, sieve.build(_whole(cache), "fingerprint"), "fingerprint")


def _missing(keys: DataFrame, cache: Stored) -> tuple[DataFrame, bool]:
    """Fingerprints without a stored result, and whether they are few enough to broadcast.

    Compared by key alone, without any text.
    """
    names = keys.select("fingerprint").join(_whole(cache).select("fingerprint"), "fingerprint", "left_anti")
    return small_side(names.distinct())


def _left_over(sifted: DataFrame, missing: DataFrame, few: bool) -> DataFrame:
    """Rows of ``sifted`` without a stored result; ``missing`` names those among the maybes.

    What the filter rules out is passed on where it is.  Only if it lets very
    many through, the text of these alone is joined by shuffle.
    """
    if few:
        marked = sifted.join(missing.withColumn("_missing", F.lit(True)), "fingerprint", "left")
        return marked.where("not _maybe or _missing").drop("_maybe", "_missing")
    sure = sifted.where("not _maybe")
    return sure.unionByName(sifted.where("_maybe").join(missing, "fingerprint", "left_semi")).drop("_maybe")


def misses(files: DataFrame, cache: Stored) -> DataFrame:
    """Files (with fingerprints) without a stored result, with all columns.

    A filter of fixed size, broadcast, tells most of them without a join; the
    few that it lets through wrongly cost a join by key.
    """
    sifted = _sifted(files, cache)
    return _left_over(sifted, *_missing(sifted.where("_maybe"), cache)).select(*files.columns)


def split(
    files: DataFrame, cache: Stored, finish: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """``(hits, rest)`` of files with a ``taken`` flag.

    ``finish`` adds fingerprints (and whatever a hit needs from its raw text).
    The keys that may be stored are written first, so jobs run while the plan is
    being built; the rest is taken files without a stored result, told by
    fingerprint, and files that are not taken.
    """
    finished = finish(files)
    sifted = _sifted(finished, cache).withColumn("_maybe", F.col("taken") & F.col("_maybe"))
    keys = stored(sifted.where("_maybe").drop("content", "_maybe"))
    rest = _left_over(sifted, *_missing(keys, cache))
    return hits(keys, cache), rest.select(*finished.columns)


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Insert or replace by fingerprint; the newest row wins."""
    return newest(cache.unionByName(fresh, allowMissingColumns=True))


def with_token_column(cache: DataFrame) -> DataFrame:
    """Bring a table written before token counts existed up to date (0 tokens)."""
    if "n_tokens" not in cache.columns:
        cache = cache.withColumn("n_tokens", F.lit(None).cast("bigint"))
    return cache.withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)).cast("bigint"))


class ResultCache:
    """Stored results on shared storage, in generations of bucketed tables per setting.

    A run's results become a generation of their own; unchanged rows are not
    written again.  A manifest, written last, names the generations that count.
    Where ``merge_at`` generations are of about the same size, they are merged,
    newest row by fingerprint, into one: a row is rewritten once for each time
    that its generation grows ``merge_at``-fold, and there are never more than
    ``merge_at`` - 1 generations of a size, so files stay as few.

    Rows are bucketed by fingerprint: a lookup shuffles the keys of the files
    and leaves the stored text where it is, in whatever generations it stands.
    ``buckets`` is fixed for a cache; about one per gigabyte of stored text.

    Two runs may append at once: a manifest comes to its number by a rename that
    replaces nothing, and who comes second adds to what the first one committed
    (on stores where such a rename is atomic).  ``kept`` manifests stay, the current one
    included, and with them the generations they name, for readers under way.
    """

    COLUMNS = (
        "fingerprint string, project string, rel_path string, content string, n_tokens bigint, "
        "created_at timestamp"
    )

    def __init__(self, spark: SparkSession, path: str, buckets: int = 1024, merge_at: int = 4, kept: int = 2) -> None:
        if merge_at < 2 or kept < 1:
            raise ValueError("merge_at is 2 or more, kept 1 or more")
        self.spark = spark
        self.path = path.rstrip("/")
        self.buckets = buckets
        self.merge_at = merge_at
        self.kept = kept
        self._path_class = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        root = self._path_class(self.path)
        self._fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        # External tables need an absolute place.
        self.path = self._fs.makeQualified(root).toString()

    def _children(self, folder: str) -> list[str]:
        path = self._path_class(folder)
        if not self._fs.exists(path):
            return []
        return [status.getPath().getName() for status in self._fs.listStatus(path)]

    def _manifests(self, config_hash: str) -> list[tuple[int, list[str]]]:
        """Numbers of manifests with the generations they name, oldest first."""
        folder = f"{self.path}/{config_hash}"
        found = []
        for name in sorted(n for n in self._children(folder) if re.fullmatch(r"manifest-\d{8}", n)):
            stream = self._fs.open(self._path_class(f"{folder}/{name}"))
            try:
                found.append((int(name[-8:]), bytes(stream.readAllBytes()).decode().split()))
            finally:
                stream.close()
        return found

    def generations(self, options: JobOptions, method: str = HEURISTIC) -> list[str]:
        """Folders of the generations that count."""
        config_hash = self._key(options, method)
        return [f"{self.path}/{config_hash}/{name}" for name in self._named(config_hash)]

    def _named(self, config_hash: str) -> list[str]:
        manifests = self._manifests(config_hash)
        return manifests[-1][1] if manifests else self._unlisted(config_hash)

    def _unlisted(self, config_hash: str) -> list[str]:
        """The table of a cache from before there were manifests: its last finished version."""
        folder = f"{self.path}/{config_hash}"
        versions = [
            int(name[1:]) for name in self._children(folder)
            if re.fullmatch(r"v\d+", name) and self._fs.exists(self._path_class(f"{folder}/{name}/_SUCCESS"))
        ]
        return [f"v{max(versions)}"] if versions else []

    def _commit(self, config_hash: str, add: list[str], drop: list[str] = ()) -> bool:
        """Write the next manifest; false if another writer has merged what is to be dropped."""
        folder = f"{self.path}/{config_hash}"
        draft = self._path_class(f"{folder}/_draft-{uuid.uuid4().hex}")
        while True:
            # The number follows from the very manifest that this one adds to.
            number, names = (self._manifests(config_hash) or [(0, self._unlisted(config_hash))])[-1]
            if not set(drop) <= set(names):
                return False
            listed = [n for n in names if n not in set(drop)] + add
            stream = self._fs.create(draft, True)
            stream.write(bytearray("".join(f"{n}\n" for n in listed).encode()))
            stream.close()
            if self._renamed(draft, self._path_class(f"{folder}/manifest-{number + 1:08d}")):
                return True

    def _renamed(self, source, target) -> bool:
        """Rename a file unless the target is there, which makes it false."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(
            self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()
        )
        no_options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            context.rename(source, target, no_options)
        except Py4JJavaError:
            if self._fs.exists(target):
                return False
            raise
        return True

    def _table(self, config_hash: str, generation: str) -> str:
        """Name of the external table over one generation, declared if need be."""
        place = f"{self.path}/{config_hash}/{generation}"
        name = f"corpusmill_results_{hashlib.md5(place.encode()).hexdigest()}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({self.COLUMNS}) USING parquet "
            f"CLUSTERED BY (fingerprint) SORTED BY (fingerprint) INTO {self.buckets} BUCKETS "
            f"LOCATION '{place}'"
        )
        self.spark.catalog.refreshTable(name)
        return name

    @staticmethod
    def _key(options: JobOptions, method: str) -> str:
        """Settings and counting method: counts of one method never serve another."""
        return hashlib.md5(f"{options.config_fingerprint()}|{method}".encode()).hexdigest()

    def _rows(self, config_hash: str, generations: list[str]) -> list[DataFrame]:
        return [with_token_column(self.spark.table(self._table(config_hash, g))) for g in generations]

    def tables(self, options: JobOptions, method: str = HEURISTIC) -> list[DataFrame]:
        """Stored rows of one setting and counting method, a bucketed table for each generation."""
        config_hash = self._key(options, method)
        return self._rows(config_hash, self._named(config_hash))

    def read(self, options: JobOptions, method: str = HEURISTIC) -> DataFrame | None:
        """All these rows together; None when there are none."""
        tables = self.tables(options, method)
        return _whole(tables) if tables else None

    def _write(self, rows: DataFrame, config_hash: str) -> str:
        generation = f"g{uuid.uuid4().hex}"
        name = self._table(config_hash, generation)
        columns = [c.split()[0] for c in self.COLUMNS.split(", ")]
        # Dealt out like the buckets, so that each task writes one file.
        rows.select(*columns).repartition(self.buckets, "fingerprint").write.insertInto(name)
        return generation

    def append(self, rows: DataFrame, options: JobOptions, method: str = HEURISTIC) -> None:
        """Add a run's results, and merge generations where there are too many of a size."""
        config_hash = self._key(options, method)
        added = self._write(rows, config_hash)
        if self._bytes(config_hash, added):
            self._commit(config_hash, [added])
        while full := self._full_tier(config_hash):
            if not self._merge(config_hash, full):
                break
        self._drop_unnamed(config_hash)

    def compact(self, options: JobOptions, method: str = HEURISTIC) -> None:
        """Merge all generations into one, with the newest row per fingerprint."""
        config_hash = self._key(options, method)
        generations = self._named(config_hash)
        if generations and self._merge(config_hash, generations):
            self._drop_unnamed(config_hash)

    def _merge(self, config_hash: str, generations: list[str]) -> bool:
        merged = self._write(newest(self._rows(config_hash, generations)), config_hash)
        return self._commit(config_hash, [merged], generations)

    def _bytes(self, config_hash: str, generation: str) -> int:
        place = self._path_class(f"{self.path}/{config_hash}/{generation}")
        return sum(s.getLen() for s in self._fs.listStatus(place) if s.getPath().getName().endswith(".parquet"))

    def _full_tier(self, config_hash: str) -> list[str]:
        """The smallest generations that are ``merge_at`` or more of about one size."""
        tiers: dict[int, list[str]] = {}
        for generation in self._named(config_hash):
            size = max(self._bytes(config_hash, generation), 1)
            tiers.setdefault(int(math.log(size, self.merge_at)), []).append(generation)
        full = [tier for tier, members in tiers.items() if len(members) >= self.merge_at]
        # Smaller ones would be in the way of the next merge, so they go along.
        return [g for tier, members in tiers.items() if tier <= min(full) for g in members] if full else []

    def _drop_unnamed(self, config_hash: str) -> None:
        """Delete old manifests and the generations that they alone name.

        A generation that no manifest names yet may be another run's: it stays.
        """
        manifests = self._manifests(config_hash)
        old, current = manifests[: -self.kept], manifests[-self.kept :]
        in_use = {g for _, names in current for g in names}
        for number, names in old:
            for generation in set(names) - in_use:
                place = self._path_class(f"{self.path}/{config_hash}/{generation}")
                if self._fs.exists(place):
                    self.spark.sql(f"DROP TABLE IF EXISTS {self._table(config_hash, generation)}")
                    self._fs.delete(place, True)
            # Last, so that a run that is stopped here leaves the rest to the next one.
            self._fs.delete(self._path_class(f"{self.path}/{config_hash}/manifest-{number:08d}"), False)

    def purge(self) -> None:
        """Forget the results of all settings; what this class did not write stays."""
        for config_hash in self._children(self.path):
            if not re.fullmatch("[0-9a-f]{32}", config_hash):
                continue
            folder = f"{self.path}/{config_hash}"
            own = [n for n in self._children(folder) if re.fullmatch(r"g[0-9a-f]{32}|v\d+", n)
                   and self._fs.exists(self._path_class(f"{folder}/{n}/_SUCCESS"))]
            for generation in own:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._table(config_hash, generation)}")
            if own:
                self._fs.delete(self._path_class(folder), True)
