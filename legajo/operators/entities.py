"""Entity mentions, aliases, co-occurrence networks and graph measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.functions import text as tx
from legajo.operators.claimrules import TYPES
from legajo.session import checkpointed, salt_of

#: A run of capitalised words, small link words between them; the default where no recogniser is plugged in.
NAME = r"[A-ZÁÉÍÓÚÑ][\p{L}]+(?:(?: de| del| de la| y)? [A-ZÁÉÍÓÚÑ][\p{L}]+)+"
PUBLIC = r"ministerio|superintendencia|agencia|unidad|instituto|contraloría|procuraduría|fiscalía|corte|fondo|comisión|consejo|tribunal|hospital|defensoría|secretaría|auditoría|registro"
_DEFINITION = r"([A-ZÁÉÍÓÚÑ][\p{L}]+(?: [\p{L}]+){1,8}) \(([A-ZÁÉÍÓÚÑ]{2,10})\)"


def mentions(sentences: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """One row per mention: keys, entity, entity_type, method. Names are found by capitals, the other types by pattern."""
    keys = keys or ["document_id", "paragraph_id", "sent_no", "page", "level2"]
    typed = F.array(
        *[F.struct(F.lit(kind).alias("entity_type"), F.lit("pattern").alias("method"), F.regexp_extract_all(text, F.lit(f"({rx})"), F.lit(1)).alias("found")) for kind, rx in TYPES.items()],
        F.struct(F.lit("NAME").alias("entity_type"), F.lit("capitals").alias("method"), F.regexp_extract_all(text, F.lit(f"({NAME}+)"), F.lit(1)).alias("found")),  # possessive
    )
    rows = sentences.select(*keys, F.explode(typed).alias("m")).select(*keys, "m.entity_type", "m.method", F.explode("m.found").alias("raw"))
    return rows.select(*keys, tx.surface(F.col("raw")).alias("entity"), "entity_type", "method").where(F.length("entity") > 1)


def without_overlaps(found: DataFrame, sentence: list[str]) -> DataFrame:
    """Names dropped where a pattern mention of more than six characters of the same sentence holds them or lies in them."""
    patterns = found.where((F.col("method") == "pattern") & (F.length("entity") > 6)).select(*sentence, F.lower("entity").alias("_p")).distinct()
    names = found.where("method = 'capitals'")
    clash = F.lower("entity").contains(F.col("_p")) | F.col("_p").contains(F.lower("entity"))
    hit = names.join(patterns, sentence).where(clash).select(*sentence, "entity").distinct()
    return names.join(hit, [*sentence, "entity"], "left_anti").unionByName(found.where("method = 'pattern'"))


def is_public(name: Column) -> Column:
    return F.lower(name).rlike(rf"(^|[^\p{{L}}])(?:{PUBLIC})([^\p{{L}}]|$)")


def summary(found: DataFrame) -> DataFrame:
    """entity, entity_type, n, pages, sections and the number of paragraphs. Distinct lists are gathered from distinct rows."""
    counts = found.groupBy("entity", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.bool_or(is_public(F.col("entity"))).alias("is_public"))
    pages = found.groupBy("entity", "entity_type", "document_id", "page").count().groupBy("entity", "entity_type").agg(F.count(F.lit(1)).alias("n_pages"))
    paragraphs = found.groupBy("entity", "entity_type", "paragraph_id").count().groupBy("entity", "entity_type").agg(F.count(F.lit(1)).alias("n_paragraphs"))
    sections = found.select("entity", "entity_type", "level2").distinct().groupBy("entity", "entity_type").agg(F.array_join(F.array_sort(F.collect_list("level2")), " | ").alias("sections"))
    keys = ["entity", "entity_type"]
    return counts.join(pages, keys).join(paragraphs, keys).join(sections, keys)


def modal_type(found: DataFrame) -> DataFrame:
    """entity and its most frequent type (the first among equals)."""
    counts = found.groupBy("entity", "entity_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("entity").agg(F.min_by("entity_type", F.struct((-F.col("n")).alias("n"), F.col("entity_type"))).alias("entity_type"))


def pairs(members: DataFrame, window: str, item: str, least_items: int = 1, least_weight: int = 1, salts: int = 8) -> DataFrame:
    """a < b and weight: in how many windows two items stand together. A window is a sentence or paragraph, so that the pairs
    of one are bounded by its length; frequent items are thinned only by ``least_items``, never capped."""
    distinct = members.select(window, item).distinct()
    if least_items > 1:
        often = members.groupBy(item).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_items).select(item)
        distinct = distinct.join(often, item, "left_semi")
    grouped = distinct.groupBy(window).agg(F.array_sort(F.collect_list(item)).alias("v")).where(F.size("v") > 1)
    couples = F.expr("flatten(transform(v, (x, i) -> transform(slice(v, i + 2, size(v)), y -> struct(x as a, y as b))))")
    edges = grouped.select(F.explode(couples).alias("p"), salt_of(window, salts=salts).alias("_salt"))
    partial = edges.groupBy("p.a", "p.b", "_salt").agg(F.count(F.lit(1)).alias("w"))
    return partial.groupBy("a", "b").agg(F.sum("w").alias("weight")).where(F.col("weight") >= least_weight)


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree and weighted degree."""
    ends = edges.select(F.col("a").alias("node"), "weight").unionByName(edges.select(F.col("b").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def density(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges and the share of possible edges that exist."""
    nodes = degrees(edges).agg(F.count(F.lit(1)).alias("nodes"))
    count = edges.agg(F.count(F.lit(1)).alias("edges"))
    both = nodes.crossJoin(count)  # one row each
    return both.select("nodes", "edges", F.when(F.col("nodes") > 1, F.round(2.0 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 6)).alias("density"))


def among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (a column node)."""
    return edges.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(nodes.select(F.col("node").alias("b")), "b", "left_semi")


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """The neighbours of one node with the weight of the edge."""
    out = edges.where(F.col("a") == node).select(F.col("b").alias("node"), "weight")
    return out.unionByName(edges.where(F.col("b") == node).select(F.col("a").alias("node"), "weight"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node and component (its least node), by large-star and small-star steps: the depth of the forest falls by half in each
    round, and a hub's rows are joined by key, never gathered. Raises if ``rounds`` do not suffice."""
    links = checkpointed(edges.select("a", "b").where("a <> b").distinct())
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select("a", "b", "m")
        new = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = checkpointed(new)
        if new.exceptAll(links).isEmpty() and links.exceptAll(new).isEmpty():
            leaves = new.select(F.col("a").alias("node"), F.col("b").alias("component"))
            roots = new.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return leaves.unionByName(roots)
        links = new
    raise RuntimeError(f"components are not found after {rounds} rounds")


def acronyms(sentences: DataFrame, text: str = "text") -> DataFrame:
    """alias and canonical of "Long Form (LF)" where the initials of the long form's last words spell the acronym."""
    found = sentences.select(F.col(text).alias("t")).where(F.col("t").rlike(_DEFINITION))
    found = found.select(F.regexp_extract("t", _DEFINITION, 1).alias("long"), F.regexp_extract("t", _DEFINITION, 2).alias("alias"))
    words = F.filter(F.split("long", " "), lambda w: w != "")
    # all ends of the long form whose capital initials are the acronym; the longest that begins with a capital
    ends = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.slice("w", i, F.size("w") - i + 1))
    initials = lambda e: F.array_join(F.transform(F.filter(e, lambda x: ~F.lower(x).isin("de", "del", "la", "las", "los", "el", "y", "e", "para", "en", "a", "al", "por")), lambda x: F.upper(F.substring(x, F.lit(1), F.lit(1)))), "")
    good = F.filter("ends", lambda e: (initials(e) == F.col("alias")) & F.get(e, F.lit(0)).rlike("^[A-ZÁÉÍÓÚÑ]"))
    kept = found.withColumn("w", words).withColumn("ends", ends).withColumn("good", good).where(F.size("good") > 0)
    return kept.groupBy("alias").agg(F.min(tx.surface(F.array_join(F.get("good", F.lit(0)), " "))).alias("canonical"))


def merge_log(renamed: DataFrame, name: str) -> DataFrame:
    """name, canonical and how many mentions got another name."""
    changed = renamed.where(F.col(name) != F.col("canonical"))
    return changed.groupBy(name, "canonical").agg(F.count(F.lit(1)).alias("n_merged"))
