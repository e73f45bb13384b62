"""An audit that is kept up to date by the changes of an inventory.

What an audit is made of stays written: the signals as a log of signed rows, the sums of every unit, the places that count, the findings
and the totals of every root.  Changes become signed signals.  Sums and counts of units take them as they are.  A maximum
or a bit can only be lost with a file that held it: such units alone are read again, from the log.  Places of units that changed are
made again from the units, and findings of roots and detectors whose places changed from the places.  So an update reads the changes,
the units and - only where something was lost - the log, never the inventory.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heftmap.operators import audit as A
from heftmap.operators import detectors as D
from heftmap.operators import inventory as I
from heftmap.operators import spread
from heftmap.operators.staging import stage
from heftmap.schemas import FILES

TIMES = "times"
_PLACE = ("root_id", "detector", "place")
_FINDING = ("root_id", "detector")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(the FILES columns, times): rows to add (1, 2, ...) and to take away (-1, -2, ...) to make one inventory of the other.

    A file whose size, hash or access changed is taken away and added; equal rows of both do not appear, however often they repeat.
    """
    # Hashes are most of what is shuffled: lower-case hex digits go as the bytes they stand for, any other text as it is.
    text = F.col("content_sha256")
    digits = F.coalesce(F.lower(F.hex(F.unhex(text))) == text, F.lit(False))
    packed = {"content_sha256": F.when(~digits, text), "_bytes": F.when(digits, F.unhex(text))}
    signed = lambda files, sign: files.select(*FILES.names, F.lit(sign).cast("bigint").alias(TIMES)).withColumns(packed)
    both = signed(before, -1).unionByName(signed(after, 1))
    changed = both.groupBy(*FILES.names, "_bytes").agg(F.sum(TIMES).alias(TIMES)).where(F.col(TIMES) != 0)
    return changed.withColumn("content_sha256", F.coalesce("content_sha256", F.lower(F.hex("_bytes")))).select(*FILES.names, TIMES)


@dataclass(frozen=True)
class AuditState:
    """The written parts of an audit.  ``log`` is one table, or several after updates."""

    detectors: tuple[str, ...]
    log: tuple[DataFrame, ...]
    units: DataFrame
    places: DataFrame
    findings: DataFrame
    totals: DataFrame

    def audit(self) -> DataFrame:
        """As ``audit`` of the inventory: one scored row per root."""
        return A.aggregate(self.findings, self.totals)

    def save(self, path: str) -> None:
        """Writes the state to a folder; in the log, what was added and taken away again is gone."""
        log = reduce(DataFrame.unionByName, self.log)
        left = log.groupBy(*(c for c in log.columns if c != TIMES)).agg(F.sum(TIMES).alias(TIMES)).where(F.col(TIMES) != 0)
        left.write.parquet(f"{path}/log")
        for name in ("units", "places", "findings", "totals"):
            getattr(self, name).write.parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, detectors: Sequence[str] = D.ROSTER) -> AuditState:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return AuditState(tuple(detectors), (read("log"),), *(read(n) for n in ("units", "places", "findings", "totals")))


def _signals(files: DataFrame, detectors: Sequence[str], sign: int) -> DataFrame:
    found = D.signals(files, detectors).withColumn(TIMES, F.lit(sign).cast("bigint"))
    return found.withColumns({k: F.coalesce(k, F.lit("")) for k in ("parent", "unit")})


def _signed_signals(changed: DataFrame, detectors: Sequence[str]) -> DataFrame:
    """Signals of changed rows; a row that counts more than once gives its signals as often."""
    def of(sign: int) -> DataFrame:
        rows = changed.where(F.col(TIMES) * sign > 0)
        repeated = rows.select(*FILES.names, F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs(TIMES))).alias("_nth")).drop("_nth")
        return _signals(repeated, detectors, sign)

    return of(1).unionByName(of(-1))


def start(files: DataFrame, detectors: Sequence[str] = D.ROSTER) -> AuditState:
    """The state of an inventory.  Runs jobs while it is called."""
    detectors = tuple(D._check(detectors))
    log = stage(_signals(files, detectors, 1), "log")
    units = stage(D.unit_sums(log), "units")
    places = stage(D.places(D.units_from(units)), "places")
    return AuditState(detectors, (log,), units, places, stage(D.findings_from(places), "findings"), stage(I.census_totals(files), "totals"))


def _new_totals(totals: DataFrame, changed: DataFrame) -> DataFrame:
    size = F.coalesce(F.col("size_bytes"), F.lit(0)) * F.col(TIMES)
    moved = I.only_files(changed).groupBy("root_id").agg(F.sum(TIMES).alias("file_count"), F.sum(size).alias("total_bytes"))
    both = totals.unionByName(moved).groupBy("root_id").agg(F.sum("file_count").alias("file_count"), F.sum("total_bytes").alias("total_bytes"))
    return both.where(F.col("file_count") > 0)


def _moved_units(state: AuditState, delta: DataFrame, log: Sequence[DataFrame]) -> DataFrame:
    """The sums of the units that the signed signals touch, as they were (``old``) and as they are (``new``, NULL where nothing is left)."""
    times, size = F.col(TIMES), F.col("size_bytes")
    gone, come = times < 0, times > 0
    moves = delta.groupBy(*D.UNIT_KEYS).agg(
        F.sum(times).alias("d_n"), F.sum(size * times).alias("d_bytes"), F.coalesce(F.sum(F.when(F.col("mark"), times)), F.lit(0)).alias("d_marked_n"),
        F.coalesce(F.sum(F.when(F.col("mark"), size * times)), F.lit(0)).alias("d_marked_bytes"),
        F.max(F.when(gone, size)).alias("gone_largest"), F.max(F.when(come, size)).alias("come_largest"),
        F.coalesce(F.bit_or(F.when(gone, F.col("bits"))), F.lit(0)).alias("gone_bits"), F.coalesce(F.bit_or(F.when(come, F.col("bits"))), F.lit(0)).alias("come_bits"),
        spread.salt_mask("path"))
    was = state.units.withColumnRenamed(spread.MASK, "old_mask").withColumn("known", F.lit(True))
    met = moves.join(was, list(D.UNIT_KEYS), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    known = F.coalesce(F.col("known"), F.lit(False))
    largest = F.greatest("largest_file", "come_largest")
    # The largest file is lost if one of its size went and nothing as large came.
    lost_largest = known & (F.col("gone_largest") >= F.col("largest_file")) & (F.coalesce(F.col("come_largest"), F.lit(-1)) < F.col("largest_file"))
    lost_bits = known & (F.col("gone_bits").bitwiseAND(F.bitwise_not("come_bits")) != 0)
    n = zero("n") + F.col("d_n")
    # What is added and taken away in the same changes may hold no file any more: a unit without an old one is read from the log if anything went.
    unsure = (n > 0) & (lost_largest | lost_bits | (~known & F.col("gone_largest").isNotNull()))
    moved = stage(met.select(
        *D.UNIT_KEYS, known.alias("known"), unsure.alias("unsure"),
        F.struct("n", "bytes", "marked_n", "marked_bytes", "largest_file", "bits", F.col("old_mask").alias(spread.MASK)).alias("old"),
        F.struct(n.alias("n"), (zero("bytes") + F.col("d_bytes")).alias("bytes"), (zero("marked_n") + F.col("d_marked_n")).alias("marked_n"),
                 (zero("marked_bytes") + F.col("d_marked_bytes")).alias("marked_bytes"), largest.alias("largest_file"),
                 zero("bits").bitwiseOR(F.col("come_bits")).cast("int").alias("bits"),
                 F.coalesce("old_mask", F.lit(0)).bitwiseOR(F.col(spread.MASK)).alias(spread.MASK)).alias("new")), "moved-units")
    lost = moved.where("unsure").select(*D.UNIT_KEYS)
    rows = reduce(DataFrame.unionByName, log).join(lost, list(D.UNIT_KEYS), "left_semi")
    held = rows.groupBy(*D.UNIT_KEYS, "size_bytes", "bits").agg(F.sum(TIMES).alias("left")).where(F.col("left") > 0)
    again = held.groupBy(*D.UNIT_KEYS).agg(F.max("size_bytes").alias("read_largest"), F.bit_or("bits").alias("read_bits"))
    filled = moved.join(again, list(D.UNIT_KEYS), "left")
    new = F.col("new").withField("largest_file", F.coalesce("read_largest", "new.largest_file")).withField("bits", F.coalesce("read_bits", "new.bits"))
    return filled.select(*D.UNIT_KEYS, F.when(F.col("known"), F.col("old")).alias("old"), F.when(F.col("new.n") > 0, new).alias("new"))


def update(state: AuditState, changed: DataFrame) -> AuditState:
    """The state after ``changed``, rows as ``changes`` gives them.  Runs jobs while it is called; the old state's tables stay as they are."""
    changed = stage(changed.select(*FILES.names, TIMES), "changes")
    delta = stage(_signed_signals(changed, state.detectors), "log")
    log = (*state.log, delta)
    moved = stage(_moved_units(state, delta, log), "moved")
    sums = lambda which: moved.where(F.col(which).isNotNull()).select(*D.UNIT_KEYS, f"{which}.*")
    names = state.units.columns
    units = stage(state.units.join(moved, list(D.UNIT_KEYS), "left_anti").select(*names).unionByName(sums("new").select(*names)), "units")
    touched = stage(D.units_from(sums("old")).select(*_PLACE).unionByName(D.units_from(sums("new")).select(*_PLACE)).distinct(), "touched")
    again = D.places(D.units_from(units).join(touched, list(_PLACE), "left_semi"))
    columns = state.places.columns
    kept = state.places.join(touched, list(_PLACE), "left_anti")
    places = stage(kept.select(*columns).unionByName(again.select(*columns)), "places")
    hit = touched.select(*_FINDING).distinct()
    fresh = D.findings_from(places.join(hit, list(_FINDING), "left_semi"))
    findings = state.findings.join(hit, list(_FINDING), "left_anti").unionByName(fresh)
    return replace(state, log=log, units=units, places=places, findings=stage(findings, "findings"), totals=stage(_new_totals(state.totals, changed), "totals"))
