"""Path expressions on Columns: cleaning, extraction from text, and placing relative to a working directory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions.text import let, trim_space

# The patterns that decide which texts are paths. Group 1 (or 2) is the path.
PATH_LINE = r"""(?:^|[\t\n\f\r "'(\[])([A-Za-z0-9_./@+-]*[A-Za-z0-9_/@+-]\.[A-Za-z0-9][A-Za-z0-9._-]*):([0-9]+)"""
PATH_ONLY = r"""(?:^|[\t\n\f\r "'(\[])([./~A-Za-z0-9_@+-]*[/][A-Za-z0-9_./~@+-]*\.[A-Za-z0-9][A-Za-z0-9._-]*)(?:\z|[\t\n\f\r "',)\]:;])"""
COMMAND_PATH = r"""(?:^|[\t\n\f\r "'=])([./~A-Za-z0-9_@+-]+\.[A-Za-z0-9][A-Za-z0-9._-]*)(?:\z|[\t\n\f\r "',)\]:;])"""
PATCH_FILE = r"(?dm)^\*\*\* (?:Add|Update|Delete) File: (.+)$|^\*\*\* Move to: (.+)$"

HIT = "array<struct<path:string,lines:array<array<bigint>>>>"
NO_LINES = "array<array<bigint>>"


def path_clean(path: Column) -> Column:
    """The shortest equal path: no empty or dot parts, parents resolved; '.' if nothing is left."""

    def clean(p: Column) -> Column:
        rooted = F.startswith(p, F.lit("/"))

        def step(acc: Column, part: Column) -> Column:
            last = F.try_element_at(acc, F.lit(-1))
            up = F.when((F.size(acc) > 0) & (last != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).when(rooted, acc).otherwise(F.array_append(acc, part))
            return F.when(part == "..", up).otherwise(F.array_append(acc, part))

        parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
        resolved = F.when(F.array_contains(parts, ".."), F.aggregate(parts, F.array().cast("array<string>"), step)).otherwise(parts)
        return let(F.array_join(resolved, "/"), lambda joined: F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined))

    return let(path, clean)


def base_name(path: Column) -> Column:
    """The last part of a path; '.' for an empty one, '/' for the root."""
    bare = F.regexp_replace(path, r"/+\z", "")
    return F.when(path == "", ".").when(bare == "", "/").otherwise(F.regexp_extract(bare, r"(?s)([^/]*)\z", 1))


def under(root: Column, path: Column) -> Column:
    """The path relative to a root, both clean and absolute; null if it does not lie under it ('.' if it is it)."""
    head = F.when(root == "/", root).otherwise(F.concat(root, F.lit("/")))
    return (
        F.when(~F.startswith(root, F.lit("/")), None)
        .when(path == root, ".")
        .when(F.startswith(path, head), F.substr(path, F.length(head) + 1, F.length(path)))
    )


def extracted(path: Column, top_level: bool) -> Column:
    """A path found in a text, without quotes, brackets and diff prefixes; null if it can't be one."""
    bare = trim_space(F.regexp_replace(path, r"""^["' ,;:()\[\]{}]+|["' ,;:()\[\]{}]+\z""", ""))
    bare = F.regexp_replace(bare, "^(a/)?(b/)?([.]/)?", "")

    def checked(p: Column) -> Column:
        bad = (p == "") | F.contains(p, F.lit("://")) | p.rlike(r"[\n\r\t]") | F.startswith(p, F.lit("--")) | F.startswith(p, F.lit("++"))
        return F.when(~(bad if top_level else bad | ~F.contains(p, F.lit("/"))), p)

    return let(bare, checked)


def _distinct(paths: Column, top_level: bool) -> Column:
    kept = F.filter(F.transform(paths, lambda p: extracted(p, top_level)), lambda p: p.isNotNull())
    return F.array_sort(F.array_distinct(kept))


def extract_paths(text: Column) -> Column:
    """All paths with a slash in a text, sorted."""
    return _distinct(F.regexp_extract_all(text, F.lit(PATH_ONLY), F.lit(1)), False)


def command_paths(command: Column) -> Column:
    """All file names in a command, with or without a slash, sorted."""
    return _distinct(F.regexp_extract_all(command, F.lit(COMMAND_PATH), F.lit(1)), True)


def patch_paths(patch: Column) -> Column:
    """All files that a patch adds, updates, deletes or moves to, sorted."""
    a, b = (F.regexp_extract_all(patch, F.lit(PATCH_FILE), F.lit(k)) for k in (1, 2))
    return _distinct(F.zip_with(a, b, lambda x, y: F.when(x != "", x).otherwise(y)), True)


def path_hits(text: Column) -> Column:
    """All paths of a text with the lines (as [n, n]) that follow them after a colon, sorted by path."""
    names, numbers = (F.regexp_extract_all(text, F.lit(PATH_LINE), F.lit(k)) for k in (1, 2))
    found = F.zip_with(names, numbers, lambda p, n: F.struct(extracted(p, True).alias("path"), n.try_cast("bigint").alias("line")))
    found = F.filter(found, lambda x: x["path"].isNotNull() & (x["line"] > 0))
    numbered = F.transform(found, lambda x, i: F.struct(x["path"].alias("path"), i.alias("i"), F.array(F.array(x["line"], x["line"])).alias("lines")))
    bare = F.transform(extract_paths(text), lambda p: F.struct(p.alias("path"), F.lit(2147483647).alias("i"), F.array().cast(NO_LINES).alias("lines")))
    return _runs(F.array_sort(F.concat(numbered, bare)))


def _runs(sorted_hits: Column) -> Column:
    """Hits sorted by path, with those of one path as one."""

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["path"].alias("path"), F.concat(last["lines"], x["lines"]).alias("lines"))
        own = F.struct(x["path"].alias("path"), x["lines"].alias("lines"))
        return F.when(last["path"] == x["path"], F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), joined)).otherwise(F.array_append(acc, own))

    return F.aggregate(sorted_hits, F.array().cast(HIT), step)


def outside_scope(path: Column, home: str = "", tmp: str = "") -> Column:
    """Where a clean absolute path outside the working directory lies: home, tmp or other."""
    tmp_head = F.startswith(path, F.lit(tmp or "/tmp"))
    if not home:
        return F.when(tmp_head, "tmp").otherwise("other")
    rel = under(path_clean(F.lit(home)), path)
    return F.when(rel.isNotNull() & ~F.startswith(rel, F.lit("..")), "home").when(tmp_head, "tmp").otherwise("other")


def normalize_path(path: Column, cwd: Column, base: Column, home: str = "", tmp: str = "") -> Column:
    """struct(rel, scope, outside): a path in the working directory, or the scope and path outside; null if it is none.

    A relative path counts from base, if that is absolute; otherwise it stays as it is, even without a working directory.
    """
    return placed_under(path, F.when(cwd != "", path_clean(cwd)), base, home, tmp)


def placed_under(path: Column, root: Column, base: Column, home: str = "", tmp: str = "") -> Column:
    """normalize_path for a working directory that is clean already; null if there is none."""
    none = F.lit(None).cast("string")
    kind = "struct<rel:string,scope:string,outside:string>"

    def place(whole: Column) -> Column:
        def decide(rel: Column) -> Column:
            inside = rel.isNotNull() & ~F.startswith(rel, F.lit("..")) & (rel != ".")
            return F.when(inside, F.struct(rel.alias("rel"), none.alias("scope"), none.alias("outside"))).otherwise(
                F.struct(none.alias("rel"), outside_scope(whole, home, tmp).alias("scope"), whole.alias("outside"))).cast(kind)

        return let(under(root, whole), decide)

    def from_clean(absolute: Column, clean: Column) -> Column:
        away = (clean == ".") | F.startswith(clean, F.lit(".."))
        based = F.startswith(base, F.lit("/"))
        kept = F.struct(clean.alias("rel"), none.alias("scope"), none.alias("outside")).cast(kind)
        return F.when(absolute, let(clean, place)).when(away, None).when(based, let(path_clean(F.concat(base, F.lit("/"), clean)), place)).otherwise(kept)

    def from_text(p: Column) -> Column:
        bad = p.isNull() | (p == "") | F.contains(p, F.lit("\n")) | F.startswith(p, F.lit("http://")) | F.startswith(p, F.lit("https://"))
        return F.when(~bad, let(path_clean(p), lambda clean: from_clean(F.startswith(p, F.lit("/")), clean)))

    return let(trim_space(F.regexp_replace(path, r"""^["']+|["']+\z""", "")), from_text)
