"""References to records that do not exist, are withdrawn, or arrive only later.

Parent and child keys are brought into one long form and grouped by parent table and key. A group is suspect when it
has no parent, or when its parent arrives after its first child or was deleted before its last one. Only suspect groups
are joined back to the child rows, so that the reference to a hot but sound parent is never shuffled by its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.operators.packed import unpack
from legajo.session import salt_of

#: Salts for the join of child rows with suspect keys; one key may hold a third of all rows.
SALTS = 16


def canonical_key(text: Column, letters: str = "CS") -> Column:
    """A key trimmed, in upper case, without a hyphen after its first letter and with its number padded to eight digits.

    What is not one of ``letters`` followed by digits only stays as trimmed upper-case text. Null, empty and blank keys
    give null.
    """
    t = F.upper(F.regexp_replace(text, r"^\s+|\s+$", ""))
    shape = rf"^([{letters}])-?0*([0-9]+)$"
    number = F.regexp_extract(t, shape, 2)
    padded = F.concat(F.regexp_extract(t, shape, 1), F.lpad(number, F.greatest(F.length(number), F.lit(8)), F.lit("0")))
    return F.when(t == "", None).when(t.rlike(shape), padded).otherwise(t)


def parents(df: DataFrame, parent: str, key: str, loaded: str = "loaded_at", deleted: str = "deleted_at") -> DataFrame:
    """Tagged parent keys: parent, ref_key, first delivery and first deletion."""
    return (
        df.select(F.lit(parent).alias("parent"), canonical_key(F.col(key)).alias("ref_key"), loaded, deleted)
        .where("ref_key is not null")
        .groupBy("parent", "ref_key")
        .agg(F.min(loaded).alias("born"), F.min(deleted).alias("died"))
    )


def find_orphans(children: DataFrame, all_parents: DataFrame, salts: int = SALTS) -> DataFrame:
    """Orphan references: tab, rec_id, fld, ref_key, kind, period.

    ``children`` has tab, rec_id, fld, parent, ref_key and seen (the first delivery of the referring record);
    ``all_parents`` is a union of :func:`parents`. kind is ``missing`` (no such parent), ``late`` (the parent arrives
    after the record) or ``deleted`` (the parent was deleted not after the record). Null references are no cases; a
    record without a time can only be ``missing`` and has a null period. Repeated references give one row.
    """
    children = children.where("ref_key is not null")
    no_time = F.lit(None).cast(children.schema["seen"].dataType)
    tagged = all_parents.select("parent", "ref_key", F.lit(True).alias("is_parent"), "born", "died", no_time.alias("seen")).unionByName(
        children.select("parent", "ref_key", F.lit(False).alias("is_parent"), no_time.alias("born"), no_time.alias("died"), "seen")
    )
    suspects = (
        tagged.groupBy("parent", "ref_key")  # hot keys collapse on the map side
        .agg(
            F.bool_or("is_parent").alias("has_parent"), F.min("born").alias("born"), F.min("died").alias("died"),
            F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"),
            F.count_if(~F.col("is_parent")).alias("n_children"),
        )
        .where("n_children > 0 and (not has_parent or born > first_seen or died <= last_seen)")
        .select("parent", "ref_key", "has_parent", "born", "died")
    )
    spread = suspects.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = children.withColumn("salt", salt_of("tab", "rec_id", "fld", salts=salts))
    kind = (
        F.when(~F.col("has_parent"), "missing").when(F.col("born") > F.col("seen"), "late").when(F.col("died") <= F.col("seen"), "deleted")
    )
    return (
        salted.join(spread, ["parent", "ref_key", "salt"])
        .select("tab", "rec_id", "fld", "ref_key", kind.alias("kind"), F.date_format("seen", "yyyy-MM").alias("period"))
        .where("kind is not null")
        .distinct()
    )


def references(claims: DataFrame, evidence: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The children and parents of evidence.claim_id, evidence.source_id and ledger.claim_ids."""
    of_evidence = evidence.groupBy("evidence_id", "claim_id", "source_id").agg(F.min("loaded_at").alias("seen"))
    first = of_evidence.select(
        F.lit("evidence").alias("tab"),
        F.col("evidence_id").cast("string").alias("rec_id"),
        F.inline(
            F.array(
                F.struct(F.lit("claim_id").alias("fld"), F.lit("claims").alias("parent"), canonical_key(F.col("claim_id")).alias("ref_key")),
                F.struct(F.lit("source_id").alias("fld"), F.lit("ledger").alias("parent"), canonical_key(F.col("source_id")).alias("ref_key")),
            )
        ),
        "seen",
    )
    of_ledger = ledger.groupBy("source_id", "claim_ids").agg(F.min("loaded_at").alias("seen"))
    packed = unpack(of_ledger, {"rec_id": F.col("source_id"), "seen": F.col("seen")}, ["claim_ids"])
    second = packed.select(
        F.lit("ledger").alias("tab"), "rec_id", "fld", F.lit("claims").alias("parent"), canonical_key(F.col("val")).alias("ref_key"), "seen"
    )
    keys = parents(claims, "claims", "claim_id").unionByName(parents(ledger, "ledger", "source_id"))
    return first.unionByName(second), keys


def orphans_found(claims: DataFrame, evidence: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every orphan reference of the three reference fields, one row each."""
    children, keys = references(claims, evidence, ledger)
    return find_orphans(children, keys)


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan references summed per table, field, kind and month: tab, fld, kind, period, n_refs, n_keys."""
    by_key = found.groupBy("tab", "fld", "kind", "period", "ref_key").agg(F.count(F.lit(1)).alias("n"))
    return by_key.groupBy("tab", "fld", "kind", "period").agg(
        F.sum("n").cast("bigint").alias("n_refs"), F.count(F.lit(1)).alias("n_keys")
    )
