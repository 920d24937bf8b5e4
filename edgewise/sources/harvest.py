"""What a harvest says about itself, from fact rows: workspace modules, pattern errors, omissions, symbols of positions, captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewise.functions.ids import short_name
from edgewise.graph import Graph


def workspace_modules(packages: DataFrame, module: str) -> tuple[DataFrame, DataFrame]:
    """(path, dir) of the main modules, and (id, module) of packages outside the document's own ``module``.

    ``packages`` are (id, module, module_dir, main). Both are empty where fewer than two main modules have packages: one module
    tells the paths of all.
    """
    own = packages.where("main AND coalesce(module, '') <> ''")
    modules = own.groupBy(F.col("module").alias("path")).agg(F.max("module_dir").alias("dir"))
    several = modules.groupBy().agg((F.count("*") > 1).alias("several")).where("several").select(F.lit(True).alias("_s"))
    # a row or none, so the joins keep all or nothing
    modules = modules.withColumn("_s", F.lit(True)).join(F.broadcast(several), "_s").select("path", "dir")
    other = own.where(F.col("module") != module).select("id", "module", F.lit(True).alias("_s")).distinct()
    return modules, other.join(F.broadcast(several), "_s").select("id", "module")


def first_line(text: Column) -> Column:
    """The first line of a message, without a clause that only announces the next line."""
    line = F.trim(F.substring_index(text, "\n", 1))
    announced = F.regexp_extract(line, r"^(.*); [^;]*:$", 1)
    return F.when(~line.endswith(":"), line).when(announced != "", announced).otherwise(F.regexp_replace(line, ":$", ""))


def pattern_errors(packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The packages that are some, and (id, message) of those that only carry the error of a pattern: errors, but no name, module or file.

    ``packages`` hold id, name, module, n_files and errors (array of texts) among their columns.
    """
    error = (F.size(F.coalesce("errors", F.array().cast("array<string>"))) > 0) & (F.coalesce("name", F.lit("")) == "") & F.col("module").isNull() & (F.coalesce("n_files", F.lit(0)) == 0)
    return packages.where(~error), packages.where(error).select("id", first_line(F.col("errors")[0]).alias("message"))


def pattern_limitation(packages: DataFrame) -> DataFrame:
    """(n, first, nothing) of the pattern errors, no row without any: how many, the message of the smallest id, and whether no package is left."""
    kept, errors = pattern_errors(packages)
    some = kept.limit(1).select(F.lit(True).alias("_k")).distinct()
    found = errors.groupBy().agg(F.count("*").alias("n"), F.min_by("message", "id").alias("first")).where("n > 0").withColumn("_k", F.lit(True))
    return found.join(F.broadcast(some.withColumn("_any", F.lit(True))), "_k", "left").select("n", "first", F.col("_any").isNull().alias("nothing"))


def omissions(packages: DataFrame, imports: DataFrame) -> DataFrame:
    """(what, n) of all that a package graph leaves out, rows with a count alone.

    ``packages`` are (id, package, kept, excluded, ignored, failed): loaded ones, of which a test variant has
    another id than the package it belongs to, with the number of source files left out by build
    constraints and whether loading reported an error. ``imports`` are (src, dst) of loaded ids and
    packages. Imports count once a package and target, failures and files once a package.
    """
    of = packages.groupBy("package").agg(F.bool_or("kept").alias("kept"), F.bool_or("excluded").alias("excluded"))
    loaded = packages.select(F.col("id").alias("src"), F.col("package").alias("from")).distinct()
    kept = of.where("kept").select("package")
    out = imports.join(loaded, "src").join(kept.withColumnRenamed("package", "from"), "from", "left_semi").select("from", "dst").distinct()
    out = out.join(of.withColumnRenamed("package", "dst"), "dst", "left").where("NOT coalesce(kept, false)")
    lost = out.select(F.when(F.coalesce("excluded", F.lit(False)), "imports of excluded packages").otherwise("imports outside the module").alias("what"), F.lit(1).cast("long").alias("n"))
    mine = packages.join(kept, "package", "left_semi")
    failed = mine.where("failed").select("package").distinct().select(F.lit("packages with load errors"), F.lit(1).cast("long"))
    ignored = mine.groupBy("package").agg(F.max("ignored").alias("n")).where("n > 0").select(F.lit("files of other builds"), F.col("n").cast("long"))
    variants = mine.where("id <> package").select(F.lit("test variants merged"), F.lit(1).cast("long"))
    return lost.union(failed).union(ignored).union(variants).groupBy("what").agg(F.sum("n").alias("n"))


def relative_to(file: Column, base: Column) -> Column:
    """``file`` below ``base``, with slashes, or null: what leaves the folder has no place in it."""
    base = F.regexp_replace(base, "/+$", "")
    below = F.substring(file, F.length(base) + 2, F.length(file))
    inside = file.startswith(F.concat(base, F.lit("/"))) & ~F.concat(F.lit("/"), below, F.lit("/")).contains("/../")
    return F.when(inside & (base != "") & (below != ""), below)


def symbols_of(g: Graph, ids: DataFrame, project: str) -> DataFrame:
    """(id, usr, qualified_name, kind, path, line, column) of ``ids``, in their number: null where it is no vertex; a place only inside the
    project or the document's root."""
    v = g.vertices.dropDuplicates(["id"]).select("id", "kind", "position")
    file = F.col("position.file")
    path = F.coalesce(relative_to(file, F.lit(project)), relative_to(file, F.lit(g.meta.root or project)))
    path = F.when(F.col("position.line") >= 1, path)
    known = F.col("kind").isNotNull()
    out = ids.join(v, "id", "left").withColumn("path", path)
    at = lambda c: F.when(F.col("path").isNotNull(), c)
    return out.select("id", F.when(known, F.col("id")).alias("usr"), F.when(known, short_name(F.col("id"))).alias("qualified_name"), "kind", "path", at(F.col("position.line")).alias("line"), at(F.greatest(F.coalesce("position.column", F.lit(0)), F.lit(0))).alias("column"))


# Captures


def capture_tree(files: DataFrame, deep: bool = True) -> DataFrame:
    """(folder, files, digest) of a capture (file, mode, sha256), for each folder all that is below it, or only its own files; the root
    is the empty name.

    The digest is made of sums over the files' own digests, eight words of 32 bits each, so executors add up their
    parts in any order. It tells captures apart that differ by edits; against forgers take the sorted digest.
    """
    line = F.concat(F.octet_length("file").cast("string"), F.lit(":"), "file", F.lit(":"), "mode", F.lit(":"), "sha256", F.lit("\n"))
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    above = above if deep else F.array(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))
    rows = files.select(F.sha2(line.cast("binary"), 256).alias("d"), F.explode(above).alias("folder"))
    words = [F.sum(F.conv(F.substring("d", 8 * k + 1, 8), 16, 10).cast("long")).alias(f"w{k}") for k in range(8)]
    sums = rows.groupBy("folder").agg(F.count("*").alias("files"), *words)
    return sums.select("folder", "files", F.sha2(F.concat_ws(":", "files", *(f"w{k}" for k in range(8))), 256).alias("digest"))


def differing_folders(before: DataFrame, after: DataFrame) -> DataFrame:
    """(folder, change) whose own files two captures hold differently: added, removed or changed."""
    a, b = (capture_tree(x, deep=False).select("folder", F.col("digest").alias(n)) for x, n in ((before, "a"), (after, "b")))
    d = a.join(b, "folder", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return d.select("folder", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))
