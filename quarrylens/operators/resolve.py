"""Resolution of names to symbols: containers, calls, imports, heritage.

Line ranges are matched in one sorted pass per file; names are counted before they
meet references, so no join gives more rows than it gets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quarrylens.functions.text import normal_path
from quarrylens.sources.model import CALLABLE_TYPES, CONTAINER_TYPES


def _swept(rows: DataFrame, run, schema: str) -> DataFrame:
    """One pass over each file's rows in order of their lines, wider ranges first; a task streams its files."""
    ordered = rows.filter(F.col("start_line").isNotNull() & F.col("end_line").isNotNull() & F.col("file_id").isNotNull() & F.col("repository_id").isNotNull())
    return ordered.repartition("repository_id", "file_id").sortWithinPartitions(
        "repository_id", "file_id", "start_line", F.desc("end_line"), "id").mapInPandas(run, schema)


def _groups(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[list[tuple]]:
    """Rows with the same first four columns (repository, file, start, end), in order."""
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch[c] for c in columns)):
            if group and group[0][:4] != row[:4]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def containers_of(symbols: DataFrame) -> DataFrame:
    """id, container_id: the smallest type of the same file whose lines cover the symbol's; ties by line and id.

    A symbol does not contain itself. symbols: id, repository_id, file_id, type, start_line, end_line.
    Each file is passed once, with the types still open at a line on a stack.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stack, out = None, [], []
        for group in _groups(batches, ["repository_id", "file_id", "start_line", "end_line", "id", "is_box"]):
            repo, file, start, end = group[0][:4]
            if (repo, file) != at:
                at, stack = (repo, file), []
            stack = [b for b in stack if b[2] >= start]
            stack += [(end - start, start, end, row[4]) for row in group if row[5]]
            around = sorted((span, s, i) for span, s, e, i in stack if e >= end)[:2]
            for row in group:
                best = next((i for _, _, i in around if i != row[4]), None)
                if best is not None:
                    out.append((row[4], best))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["id", "container_id"])
                out = []
        yield pd.DataFrame(out, columns=["id", "container_id"])

    return _swept(symbols.select("id", "repository_id", "file_id", "start_line", "end_line", F.coalesce(
        F.col("type").isin(*CONTAINER_TYPES), F.lit(False)).alias("is_box")), run, "id string, container_id string")


def drop_nested_calls(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call references without those inside a callable strictly nested in their source.

    refs: ref_id, source_id, repository_id, file_id, line, source_start, source_end.
    Each file is passed once, with the callables still open at a line on a stack.
    """
    inner = symbols.filter(F.col("type").isin("METHOD", "FUNCTION")).select(
        "id", "repository_id", "file_id", "start_line", "end_line", F.lit(None).cast("int").alias("source_start"), F.lit(None).cast("int").alias("source_end"),
        F.lit(None).cast("string").alias("ref_id"))
    # a reference comes behind every callable that begins in its line
    asked = refs.select(F.col("source_id").alias("id"), "repository_id", "file_id", F.col("line").alias("start_line"), F.lit(-1).alias("end_line"),
                        "source_start", "source_end", "ref_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stack, out = None, [], []
        for group in _groups(batches, ["repository_id", "file_id", "start_line", "end_line", "id", "source_start", "source_end", "ref_id"]):
            repo, file, line, end = group[0][:4]
            if (repo, file) != at:
                at, stack = (repo, file), []
            stack = [c for c in stack if c[1] >= line]
            for row in group:
                if row[7] is None:
                    stack.append((line, end, row[4]))
                elif any(i != row[4] and s >= row[5] and e <= row[6] and (s > row[5] or e < row[6]) for s, e, i in stack):
                    out.append((row[7],))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["ref_id"])
                out = []
        yield pd.DataFrame(out, columns=["ref_id"])

    nested = _swept(inner.unionByName(asked), run, "ref_id string")
    return refs.join(nested, "ref_id", "left_anti")


def resolve_calls(refs: DataFrame, symbols: DataFrame, containers: DataFrame) -> DataFrame:
    """ref_id, source_id, target_id, rule of each reference; target_id is null where the name stays ambiguous.

    One candidate in the repository wins; else one in the source's type (several: none);
    else one in the source's file (several: none). refs: ref_id, source_id, repository_id, name.
    Candidates are counted per name, file and type first, so that a reference meets
    three counts and not every candidate of a frequent name.
    """
    c = symbols.filter(F.col("type").isin(*CALLABLE_TYPES)).join(containers, "id", "left").select(
        "repository_id", "name", "id", F.col("file_id").alias("s_file"), F.col("container_id").alias("s_box"))

    def counted(keys: list[str], n: str, one: str) -> DataFrame:
        return c.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias(n), F.min("id").alias(one))

    s = symbols.select(F.col("id").alias("source_id"), F.col("file_id").alias("s_file")).join(
        containers.select(F.col("id").alias("source_id"), F.col("container_id").alias("s_box")), "source_id", "left")
    by_name = ["repository_id", "name"]
    votes = refs.select("ref_id", "source_id", *by_name).join(s, "source_id").join(counted(by_name, "n_repo", "only"), by_name, "left").join(
        counted([*by_name, "s_file"], "n_file", "file_one"), [*by_name, "s_file"], "left").join(
        counted([*by_name, "s_file", "s_box"], "n_box", "box_one"), [*by_name, "s_file", "s_box"], "left").na.fill(0, ["n_repo", "n_file", "n_box"])
    rule = (F.when(F.col("n_repo") == 1, "repository").when(F.col("n_box") == 1, "type").when(F.col("n_box") > 1, "ambiguous")
            .when(F.col("n_file") == 1, "file").when(F.col("n_repo") > 0, "ambiguous").otherwise("unknown"))
    target = F.when(F.col("rule") == "repository", F.col("only")).when(F.col("rule") == "type", F.col("box_one")).when(
        F.col("rule") == "file", F.col("file_one"))
    return votes.withColumn("rule", rule).select("ref_id", "source_id", target.alias("target_id"), "rule").distinct()


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """import_id, file_id, target_file_id: the one file an import names; imports with none or several are left out.

    Relative paths try the path itself, the four script endings, and index files. Java
    names match a file that is or ends with them. Other module names never match.
    imports: import_id, repository_id, file_id, path, source. files: repository_id, file_id, path.
    """
    java = F.lower("path").endswith(".java")
    base = normal_path(F.concat(F.regexp_replace(F.translate("path", "\\", "/"), "[^/]*$", ""), F.col("source")))
    endings = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    script = F.array(*[F.concat(base, F.lit(e)) for e in endings])
    wanted = F.when(java, F.array(F.concat(F.replace(F.col("source"), F.lit("."), F.lit("/")), F.lit(".java")))).when(
        F.col("source").startswith("."), script)
    candidates = imports.select("import_id", "repository_id", "file_id", F.explode(wanted).alias("key"), java.alias("by_suffix"))
    plain = files.select("repository_id", F.col("file_id").alias("target_file_id"), normal_path(F.col("path")).alias("full"))
    # a file is found by its whole path, and a Java file by every tail of it that starts at a folder
    parts = F.split("full", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    keys = plain.select("repository_id", "target_file_id", F.col("full").alias("key"), F.lit(False).alias("by_suffix")).unionByName(
        plain.filter(F.col("full").endswith(".java")).select("repository_id", "target_file_id", F.explode(tails).alias("key"), F.lit(True).alias("by_suffix")))
    return candidates.join(keys, ["repository_id", "key", "by_suffix"]).groupBy("import_id", "file_id").agg(
        F.countDistinct("target_file_id").alias("n"), F.min("target_file_id").alias("target_file_id")).filter("n = 1").drop("n")


def call_edges(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """CALLS edges of parsed files: repository_id, source_symbol_id, target_symbol_id, type."""
    calls = facts.filter("tag = 'call'").select(
        F.concat_ws(":", "file_id", F.col("no").cast("string")).alias("call_id"), "repository_id", "file_id", "name", F.col("start_line").alias("line"))
    sources = symbols.filter(F.col("type").isin("METHOD", "FUNCTION")).select(
        F.col("id").alias("source_id"), "repository_id", "file_id", F.col("start_line").alias("source_start"), F.col("end_line").alias("source_end"))
    refs = calls.join(sources, ["repository_id", "file_id"]).filter(F.col("line").between(F.col("source_start"), F.col("source_end"))).withColumn(
        "ref_id", F.concat_ws(">", "source_id", "call_id"))
    kept = drop_nested_calls(refs, symbols)
    resolved = resolve_calls(kept.select("ref_id", "source_id", "repository_id", "name"), symbols, containers_of(symbols))
    repo = symbols.select(F.col("id").alias("source_id"), "repository_id")
    return resolved.filter("target_id IS NOT NULL").join(repo, "source_id").select(
        "repository_id", F.col("source_id").alias("source_symbol_id"), F.col("target_id").alias("target_symbol_id"), F.lit("CALLS").alias("type")).distinct()


def structural_edges(facts: DataFrame, symbols: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, diagnostics) of heritage and imports of parsed files.

    A heritage target must be a class or interface (an interface for IMPLEMENTS), of the
    same file if there is one, and unique. An import goes from the file's first
    type or function to the named symbol of the imported file (its default export for
    default imports). Diagnostics: tag, name, file_id, reason of what was not resolved.
    """
    key = F.concat_ws(":", "file_id", F.col("no").cast("string"))
    h = facts.filter("tag = 'heritage'").select(
        key.alias("ref_id"), "repository_id", "file_id", "name", F.col("kind").alias("edge"), F.col("parent").alias("owner"), F.col("start_line").alias("line"))
    owners = symbols.filter(F.col("type").isin("CLASS", "INTERFACE", "ENUM")).select(
        F.col("id").alias("source_id"), "repository_id", "file_id", F.col("name").alias("owner"), "start_line", "end_line")
    owned = h.join(owners, ["repository_id", "file_id", "owner"]).filter(F.col("line").between(F.col("start_line"), F.col("end_line"))).groupBy(
        "ref_id", "repository_id", "file_id", "name", "edge").agg(F.min("source_id").alias("source_id"), F.countDistinct("source_id").alias("n_owners"))
    unowned, owned = owned.filter("n_owners > 1"), owned.filter("n_owners = 1").drop("n_owners")
    targets = symbols.filter(F.col("type").isin("CLASS", "INTERFACE")).select(
        "repository_id", "name", F.col("id").alias("t_id"), F.col("file_id").alias("t_file"), F.col("type").alias("t_type"))
    fits = (F.col("edge") == "EXTENDS") | (F.col("t_type") == "INTERFACE")
    cand = owned.join(targets, ["repository_id", "name"], "left").withColumn("ok", F.coalesce(fits & (F.col("t_id") != F.col("source_id")), F.lit(False)))
    local = F.col("ok") & (F.col("t_file") == F.col("file_id"))
    votes = cand.groupBy("ref_id", "repository_id", "file_id", "name", "edge", "source_id").agg(
        F.count_if("ok").alias("n"), F.min(F.when(F.col("ok"), F.col("t_id"))).alias("one"),
        F.count_if(local).alias("n_local"), F.min(F.when(local, F.col("t_id"))).alias("local_one"))
    target = F.when(F.col("n_local") == 1, F.col("local_one")).when((F.col("n_local") == 0) & (F.col("n") == 1), F.col("one"))
    heritage = votes.withColumn("target_id", target)

    imports = facts.filter("tag = 'import'").select(key.alias("import_id"), "repository_id", "file_id", "path", F.col("text").alias("source"), "name", "kind")
    at = resolve_imports(imports.select("import_id", "repository_id", "file_id", "path", "source"), files).select("import_id", "target_file_id")
    first = symbols.filter(F.col("type").isin("CLASS", "INTERFACE", "ENUM", "FUNCTION")).groupBy("repository_id", "file_id").agg(
        F.min(F.struct("start_line", "id")).alias("m")).select("repository_id", "file_id", F.col("m.id").alias("source_id"))
    exported = symbols.filter(F.col("type").isin("CLASS", "INTERFACE", "ENUM", "FUNCTION")).select(
        F.col("repository_id"), F.col("file_id").alias("target_file_id"), F.col("id").alias("t_id"), F.col("name").alias("t_name"),
        F.coalesce("is_default", F.lit(False)).alias("is_default"))
    named = imports.join(at, "import_id", "left").join(first, ["repository_id", "file_id"], "left").join(exported, ["repository_id", "target_file_id"], "left")
    hit = F.coalesce(F.when(F.col("kind") == "DEFAULT", F.col("is_default")).otherwise(F.col("t_name") == F.col("name")), F.lit(False))
    import_votes = named.groupBy("import_id", "repository_id", "file_id", "name", "kind", "target_file_id", "source_id").agg(
        F.count_if(hit).alias("n_hit"), F.min(F.when(hit, F.col("t_id"))).alias("hit"), F.count("t_id").alias("n_all"), F.min("t_id").alias("only"))
    # a default import of a file without a known default export means its only symbol
    alone = (F.col("kind") == "DEFAULT") & (F.col("n_hit") == 0) & (F.col("n_all") == 1)
    import_votes = import_votes.withColumn("n", F.when(alone, 1).otherwise(F.col("n_hit"))).withColumn(
        "target_id", F.when(alone, F.col("only")).otherwise(F.col("hit")))

    columns = ["repository_id", F.col("source_id").alias("source_symbol_id"), F.col("target_id").alias("target_symbol_id")]
    edges = heritage.filter("target_id IS NOT NULL").select(*columns, F.col("edge").alias("type")).unionByName(
        import_votes.filter("n = 1 AND source_id IS NOT NULL").select(*columns, F.lit("IMPORTS").alias("type"))).distinct()
    why = F.when(F.col("n") == 0, "no such symbol").otherwise("ambiguous")
    lost = unowned.select(F.lit("heritage").alias("tag"), "name", "file_id", F.lit("ambiguous source").alias("reason"))
    diagnostics = lost.unionByName(heritage.filter("target_id IS NULL").select(F.lit("heritage").alias("tag"), "name", "file_id", why.alias("reason"))).unionByName(
        import_votes.filter("n <> 1 OR source_id IS NULL").select(
            F.lit("import").alias("tag"), "name", "file_id",
            F.when(F.col("target_file_id").isNull(), "no such file").when(F.col("source_id").isNull(), "no source symbol").otherwise(why).alias("reason")))
    return edges, diagnostics
