"""What names of modules stand for: imports, re-exports and inheritance, followed to where a name is declared.

A module's name is its path without extension (its stem); a folder's `index` answers for the folder too. Facts are read off the texts in
built-in functions; names that are asked for are then followed in rounds of joins, all at once, until none moves. A name that comes
by again at a module isn't followed again, so cycles end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged, unstage

_WORD = r"[A-Za-z_$][A-Za-z0-9_$]*"
_EXTENSION = r"(\.d)?\.(ts|tsx|js|jsx|mjs)$"
_COMMENTS = r"/\*[\s\S]*?\*/|(?m:^|(?<=[\s;{}]))//[^\n]*"
_FROM = r"""\s*from\s*['"]([^'"\n]+)['"]"""


def stem_of(path: Column) -> Column:
    return F.regexp_replace(path, _EXTENSION, "")


def stems(path: Column) -> Column:
    """The names that a file is imported by."""
    bare = stem_of(path)
    return F.array_distinct(F.array(bare, F.regexp_replace(bare, "/index$", "")))


def target_stem(path: Column, module: Column) -> Column:
    """The stem that a relative module name of a file means; null for a package."""
    parts = F.split(F.concat(F.regexp_replace(path, "[^/]*$", ""), module), "/")
    empty = F.array().cast("array<string>")
    up = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(empty)
    folded = F.aggregate(parts, empty, lambda acc, p: F.when(p == "..", up(acc)).when(p.isin(".", ""), acc).otherwise(F.concat(acc, F.array(p))))
    return F.when(module.startswith("."), stem_of(F.array_join(folded, "/")))


def _named(clause: Column) -> Column:
    """The parts `a as b` between braces as structs of `name` and `known`: what it is called there and here."""
    parts = F.transform(F.split(clause, ","), lambda p: F.regexp_replace(F.btrim(F.regexp_replace(p, r"\s+", " ")), "^type ", ""))
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.named_struct(F.lit("name"), F.split(p, " as ").getItem(0), F.lit("known"), F.element_at(F.split(p, " as "), -1)))


#: What a text holds that says anything here: a relative module, or an export that isn't a declaration under its own name.
#: Letters come before the check that a word begins there: a search that has to check it everywhere takes several times as long.
_FROM_FILE = r"""from(?<=\bfrom)\s*['"]\."""
_HANDS_ON = r"""export(?<=\bexport)\s*(?:\*|\{|type\b|default\b)"""
_IMPORT = rf"\bimport\s+(?:type\s+)?([^'\"();]*?){_FROM}"
_STAR = rf"\bexport\s*\*\s*(?:as\s+({_WORD})\s*)?{_FROM}"
_PASSED = rf"\bexport\s+(?:type\s+)?\{{([^}}]*)\}}{_FROM}"
_LISTED = r"\bexport\s+(?:type\s+)?\{([^}]*)\}(?!\s*from\b)"
_DEFAULT = rf"\bexport\s+default\s+(?:(?:abstract\s+)?class\s+|(?:async\s+)?function\s*\*?\s*)?({_WORD})"


def _says(content: Column) -> Column:
    return ((content.contains("'.") | content.contains('".')) & content.rlike(_FROM_FILE)) | content.rlike(_HANDS_ON)


def statements(content: Column) -> Column:
    """The statements of a text that hand names on, with their `kind` and what their patterns take: read off in one pass; an empty array where it says nothing.

    The text without comments is named once, by a lambda: projections that are merged would work it out for every pattern.
    """

    def taken(bare: Column) -> Column:
        one = lambda pattern, g=1: F.regexp_extract_all(bare, F.lit(pattern), F.lit(g))
        row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("g1"), b.alias("g2"))
        two = lambda kind, pattern: F.zip_with(one(pattern), one(pattern, 2), lambda a, b: row(kind, a, b))
        lone = lambda kind, pattern: F.transform(one(pattern), lambda a: row(kind, a, F.lit(None).cast("string")))
        return F.concat(two("imported", _IMPORT), two("starred", _STAR), two("passed", _PASSED), lone("listed", _LISTED), lone("default", _DEFAULT))

    found = F.transform(F.array(F.regexp_replace(content, _COMMENTS, " ")), taken).getItem(0)
    return F.when(_says(content), found).otherwise(F.array().cast("array<struct<kind:string,g1:string,g2:string>>"))


def facts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imports (`filePath`, `known`, `stem`, `name`) and exports (`stem`, `known`, `to_stem`, `to_name`) of sources.

    Sources are `filePath` and their `content`, or `said`, the statements of it. `*` as a name stands for all that a module exports. An
    export of a local name leads to the module itself, or to where it was imported from. Imports of packages have no stem; exports of
    theirs aren't there.
    """
    if "said" not in files.columns:
        files = files.where(_says(F.col("content"))).select("filePath", statements(F.col("content")).alias("said"))
    said = staged(files.select("filePath", F.inline("said")), "statements")
    found = lambda kind: said.where(F.col("kind") == kind).drop("kind")
    own = lambda c: target_stem(F.col("filePath"), F.col(c))
    clause = found("imported")
    bare = F.regexp_replace("g1", r"\{[^}]*\}", "")
    spaces = F.filter(F.transform(F.split(bare, ","), lambda p: F.btrim(p)), lambda p: p != "")
    whole = F.transform(spaces, lambda p: F.named_struct(F.lit("name"), F.when(p.startswith("*"), "*").otherwise("default"), F.lit("known"), F.regexp_replace(p, r"^\*\s*as\s+", "")))
    braces = F.regexp_extract("g1", r"\{([^}]*)\}", 1)
    imports = clause.select("filePath", own("g2").alias("stem"), F.inline(F.concat(whole, _named(braces)))).select("filePath", "known", "stem", "name")
    imports = staged(imports, "facts")  # exports of what was imported read them again

    by = F.explode(stems(F.col("filePath"))).alias("stem")
    starred = found("starred")
    starred = starred.select(by, F.when(F.col("g1") == "", "*").otherwise(F.col("g1")).alias("known"), own("g2").alias("to_stem"), F.lit("*").alias("to_name"))
    passed = found("passed").select(by, own("g2").alias("to_stem"), F.inline(_named(F.col("g1"))))
    passed = passed.select("stem", "known", "to_stem", F.col("name").alias("to_name"))
    listed = found("listed").select("filePath", F.inline(_named(F.col("g1"))))
    default = found("default")
    local = listed.unionByName(default.select("filePath", F.col("g1").alias("name"), F.lit("default").alias("known")))
    met = local.alias("l").join(imports.where("stem IS NOT NULL").alias("i"), (F.col("l.filePath") == F.col("i.filePath")) & (F.col("l.name") == F.col("i.known")), "left")
    met = met.select(F.col("l.filePath").alias("filePath"), F.col("l.known").alias("known"), F.col("i.stem").alias("to"), F.coalesce("i.name", "l.name").alias("to_name"))
    local = met.select(by, "known", F.coalesce("to", stem_of(F.col("filePath"))).alias("to_stem"), "to_name")
    # a module that hands its own name on under that name says nothing
    told = local.where(~((F.col("stem") == F.col("to_stem")) & (F.col("known") == F.col("to_name"))))
    exports = starred.unionByName(passed).unionByName(told).where("to_stem IS NOT NULL").distinct()
    return imports, exports


def resolved_names(asked: DataFrame, declared: DataFrame, exports: DataFrame) -> DataFrame:
    """Names that are asked of modules (`stem`, `name`, `type`) to the declarations (`stem`, `name`, `type`, `id`) that they lead to: with `id`.

    A module's own declaration comes first, then what it names in an export, then what it exports as a whole (of which `default` is no part);
    the nearest counts, of equals the first by id. Names that lead nowhere drop out. Every round takes all names one module further.
    """
    ask = ["ask_stem", "ask_name", "type"]
    front = staged(asked.select(F.col("stem").alias("ask_stem"), F.col("name").alias("ask_name"), "type", "stem", "name", F.lit(0).alias("starred")).distinct(), "names")
    named = exports.where("known <> '*'").select(F.col("stem").alias("s"), F.col("known").alias("k"), "to_stem", "to_name")
    whole = exports.where("known = '*'").select(F.col("stem").alias("s"), "to_stem")
    seen, found, known = front, None, None
    while not front.isEmpty():
        if known is None:  # worked out once, not in every round
            known = staged(declared.select("stem", "name", "type", "id").distinct(), "known")
        met = front.join(known, ["stem", "name", "type"])
        met = staged(met.groupBy(*ask).agg(F.min(F.struct("starred", "id")).alias("best")).select(*ask, "best.id"), "found")
        found = met if found is None else found.unionByName(met)
        open_ = front.join(met.select(*ask), ask, "left_anti")
        by_name = open_.join(named, (F.col("stem") == F.col("s")) & (F.col("name") == F.col("k"))).select(*ask, F.col("to_stem").alias("stem"), F.col("to_name").alias("name"), "starred")
        by_all = open_.where("name <> 'default'").join(whole, F.col("stem") == F.col("s")).select(*ask, F.col("to_stem").alias("stem"), "name", F.lit(1).alias("starred"))
        further = by_name.unionByName(by_all).groupBy(*ask, "stem", "name").agg(F.min("starred").alias("starred"))
        front = staged(further.join(seen.select(*ask, "stem", "name"), [*ask, "stem", "name"], "left_anti"), "names")
        seen = seen.unionByName(front)
    none = asked.select(F.col("stem").alias("ask_stem"), F.col("name").alias("ask_name"), "type", F.lit("").alias("id")).limit(0)
    out = staged((none if found is None else found).select(F.col("ask_stem").alias("stem"), F.col("ask_name").alias("name"), "type", "id"), "resolved")
    for done in (seen, *([] if found is None else [found, known])):
        unstage(done)
    return out


def inherited(asked: DataFrame, members: DataFrame, bases: DataFrame) -> DataFrame:
    """Members that are asked of classes (`owner`, `name`) to those (`owner`, `name`, `id`) of the nearest class above: with `id`.

    `bases` are rows (`owner`, `base`). Of several as near the first by id counts; classes that inherit from themselves end.
    """
    ask = ["ask", "name"]
    front = staged(asked.select(F.col("owner").alias("ask"), "name", "owner").distinct(), "members")
    seen, found, known = front, None, None
    while not front.isEmpty():
        if known is None:
            known = staged(members.select("owner", "name", "id"), "known")
        met = staged(front.join(known, ["owner", "name"]).groupBy(*ask).agg(F.min("id").alias("id")), "found")
        found = met if found is None else found.unionByName(met)
        open_ = front.join(met.select(*ask), ask, "left_anti")
        further = open_.join(bases.select("owner", "base"), "owner").select(*ask, F.col("base").alias("owner")).distinct()
        front = staged(further.join(seen, [*ask, "owner"], "left_anti"), "members")
        seen = seen.unionByName(front)
    none = asked.select(F.col("owner").alias("ask"), "name", F.lit("").alias("id")).limit(0)
    out = staged((none if found is None else found).select(F.col("ask").alias("owner"), "name", "id"), "resolved")
    for done in (seen, *([] if found is None else [found, known])):
        unstage(done)
    return out
