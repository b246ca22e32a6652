"""Domain texts (nested brackets) as tables: parameters and conditions of actions, and the type tree.

A domain is one small text; all texts of a corpus are parsed at once, token by token, with windows over each text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks of domain texts, the words that join conditions, and the type of all objects.
ACTION, PARAMETERS, PRECONDITION, EFFECT, TYPES = ":action", ":parameters", ":precondition", ":effect", ":types"
AND, NOT, DASH, ROOT = "and", "not", "-", "object"
PRE, ADD, DELETE = "pre", "add", "delete"


@dataclass(frozen=True)
class DomainTables:
    """Tables of domains.

    ``params``: ``domain, op, slot, type``, a row per parameter, and one with slot -1 per action.
    ``conds``: ``domain, op, kind, predicate, args``; an argument is a struct of its slot, or -1 and a constant.
    ``types``: ``domain, type, parent``.
    """

    params: DataFrame
    conds: DataFrame
    types: DataFrame

    def only(self, domain: str) -> DomainTables:
        """The tables of one domain, without its name."""
        return DomainTables(*(t.filter(F.col("domain") == domain).drop("domain") for t in (self.params, self.conds, self.types)))


def _tokens(texts: DataFrame) -> DataFrame:
    """Brackets and words of each text in order, with the action and the section they stand in."""
    plain = F.regexp_replace("text", r";[^\n]*", " ")
    found = F.regexp_extract_all(plain, F.lit(r"([()]|[^\s()]+)"), F.lit(1))
    rows = texts.select(F.col("name").alias("domain"), F.posexplode(found).alias("i", "token"))
    order = Window.partitionBy("domain").orderBy("i")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)

    def last(value: Column) -> Column:
        return F.last(value, ignorenulls=True).over(so_far)

    low = F.lower("token")
    before = F.coalesce(F.lag(low).over(order), F.lit(""))
    depth = F.sum(F.when(F.col("token") == "(", 1).when(F.col("token") == ")", -1).otherwise(0)).over(so_far)
    rows = rows.select("domain", "i", "token", low.alias("low"), before.alias("before"), depth.alias("depth"))
    opens = F.col("token") == "("
    rows = rows.select(
        "*",
        last(F.when(F.col("before") == ACTION, F.upper("token"))).alias("op"),
        last(F.when(F.col("token").startswith(":"), F.col("low"))).alias("section"),
        last(F.when(opens, F.col("i"))).alias("atom"),
        last(F.when(opens, F.col("before") == NOT)).alias("negated"),
    )
    return rows


def _typed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The names of typed lists with the type that follows the next dash."""
    words = rows.filter(~F.col("token").isin("(", ")") & ~F.col("token").startswith(":"))
    kind = F.when(F.col("before") == DASH, F.col("low"))
    ahead = Window.partitionBy(*keys).orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    typed = words.withColumn("type", F.coalesce(F.first(kind, ignorenulls=True).over(ahead), F.lit(ROOT)))
    return typed.filter((F.col("token") != DASH) & (F.col("before") != DASH))


def parse_domains(texts: DataFrame) -> DomainTables:
    """Tables of the domain texts ``name, text``."""
    tokens = _tokens(texts)
    keys = ["domain", "op"]
    listed = _typed(tokens.filter(F.col("section") == PARAMETERS), keys)
    slot = F.row_number().over(Window.partitionBy(*keys).orderBy("i")) - 1
    named = listed.select(*keys, slot.alias("slot"), F.col("low").alias("variable"), "type")
    actions = tokens.filter(F.col("before") == ACTION).select(*keys, F.lit(-1).alias("slot"), F.lit(None).cast("string").alias("type"))
    params = named.select(*keys, "slot", "type").unionByName(actions)

    words = tokens.filter(F.col("section").isin(PRECONDITION, EFFECT) & ~F.col("token").isin("(", ")") & ~F.col("token").startswith(":"))
    atom = [*keys, "section", "atom", "negated"]
    bound = words.join(named.withColumnRenamed("type", "_type"), (words["domain"] == named["domain"]) & (words["op"] == named["op"]) & (words["low"] == named["variable"]), "left")
    arg = F.struct(F.coalesce(named["slot"], F.lit(-1)).alias("slot"), F.when(named["slot"].isNull(), F.col("low")).alias("constant"))
    placed = bound.select(*(words[c] for c in atom), F.struct(words["i"].alias("i"), words["low"].alias("word"), arg.alias("arg")).alias("word"))
    # An atom is a few words of one text.
    atoms = placed.groupBy(*atom).agg(F.sort_array(F.collect_list("word")).alias("words"))
    head = F.get("words", F.lit(0))["word"]
    kind = F.when(F.col("section") == PRECONDITION, PRE).when(F.col("negated"), DELETE).otherwise(ADD)
    conds = atoms.filter(~head.isin(AND, NOT)).select(
        *keys,
        kind.alias("kind"),
        F.translate(head, "-", "").alias("predicate"),
        F.transform(F.slice("words", 2, 1_000_000), lambda w: w["arg"]).alias("args"),
    )
    tree = _typed(tokens.filter(F.col("section") == TYPES), ["domain"])
    types = tree.select("domain", F.col("low").alias("type"), F.col("type").alias("parent"))
    return DomainTables(params, conds, types)


def read_domains(spark, path: str) -> DomainTables:
    """Tables of a file or folder of domain texts, named by their files."""
    files = spark.read.text(path, wholetext=True)
    return parse_domains(files.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), F.col("value").alias("text")))


def ancestors(types: DataFrame) -> DataFrame:
    """Each type with itself and all types above it: ``type, ancestor``, by a recursive query over ``type, parent``.

    A path has no more steps than there are types, so a cycle ends too; its types are all above each other.
    """
    names = types.select("type").union(types.select("parent")).distinct()
    depth = names.count()
    closure = types.sparkSession.sql(
        f"""
        WITH RECURSIVE up(type, ancestor, level) AS (
          SELECT type, type, 0 FROM {{names}}
          UNION ALL
          SELECT up.type, tree.parent, level + 1 FROM up JOIN {{tree}} tree ON up.ancestor = tree.type WHERE level < {max(depth, 1)}
        )
        SELECT DISTINCT type, ancestor FROM up
        """,
        names=names,
        tree=types.select("type", "parent"),
    )
    return closure
