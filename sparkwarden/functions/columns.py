"""Column functions: paths, identifiers, tokens, flags, clamps.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import profiles as P


def any_of(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def normalize_path(path: Column) -> Column:
    """Trimmed, with forward slashes and without leading "./"."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(path, F.lit(""))), r"\\", "/"), r"^(\./)+", "")


def segments(path: Column) -> Column:
    return F.array_remove(F.split(F.lower(normalize_path(path)), "/"), "")


def module_name(path: Column) -> Column:
    """a/b/__init__.py -> a.b, a/b.py -> a.b"""
    dotted = F.translate(F.regexp_replace(normalize_path(path), r"\.py$", ""), "/", ".")
    return F.regexp_replace(dotted, r"\.__init__$", "")


def language(path: Column) -> Column:
    suffix = F.regexp_extract(F.lower(path), r"\.([^./]+)$", 1)
    return F.when(suffix == "py", "python").when(suffix != "", suffix).otherwise("unknown")


def node_id(kind: Column, path: Column, name: Column) -> Column:
    """kind:path or kind:path:name"""
    return F.concat_ws(":", kind, normalize_path(path), F.nullif(name, F.lit("")))


def canonical_id(kind: Column, path: Column, name: Column) -> Column:
    """canonical://kind/path or canonical://kind/path/name, slashes of the name as underscores."""
    return F.concat_ws("/", F.concat(F.lit("canonical://"), kind), normalize_path(path), F.nullif(F.translate(name, "/", "_"), F.lit("")))


def valid_namespace(node: Column) -> Column:
    return F.coalesce(node.rlike("^canonical://[^/]+/"), F.lit(False))


def namespace(node: Column) -> Column:
    return F.regexp_extract(F.coalesce(node, F.lit("")), "^canonical://([^/]+)/", 1)


def tokens(text: Column) -> Column:
    """Lower-case words of three letters or more, camel case split, stopwords left out; in order."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+")
    return F.filter(F.transform(parts, F.lower), lambda t: (F.length(t) >= 3) & ~t.isin(*P.STOPWORDS))


def token_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens(text)))


def first_match(choices: dict[str, Column], default: str) -> Column:
    """The first name whose condition holds."""
    out = None
    for name, condition in choices.items():
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out.otherwise(default)


def layer(path: Column) -> Column:
    s = segments(path)
    return first_match({k: F.arrays_overlap(s, any_of(v)) for k, v in P.LAYER_SEGMENTS.items()}, "unknown")


def owner(path: Column) -> Column:
    """First path segment, or the first two below the roots that hold many owners."""
    s = segments(path)
    two = F.get(s, F.lit(0)).isin(*P.TWO_SEGMENT_OWNERS)
    return F.when(F.size(s) == 0, "global").otherwise(F.array_join(F.slice(s, 1, F.when(two, 2).otherwise(1)), "/"))


def context(path: Column, generic: tuple[str, ...] = P.GENERIC_SEGMENTS) -> Column:
    """The first two path segments that are not generic, else global."""
    named = F.filter(segments(path), lambda x: ~x.isin(*generic))
    return F.when(F.size(named) == 0, "global").otherwise(F.array_join(F.slice(named, 1, 2), "/"))


def is_service(path: Column) -> Column:
    s = segments(path)
    return F.array_contains(s, "services") | F.coalesce(F.get(s, F.size(s) - 1).endswith("service.py"), F.lit(False))


def is_adapter(path: Column) -> Column:
    s = segments(path)
    return F.arrays_overlap(s, any_of(("adapter", "adapters"))) | F.coalesce(F.get(s, F.size(s) - 1).endswith("adapter.py"), F.lit(False))


def is_persistence(path: Column) -> Column:
    s = segments(path)
    ends = F.lit(False)
    for suffix in P.PERSISTENCE_SUFFIXES:
        ends = ends | F.coalesce(F.get(s, F.size(s) - 1).endswith(suffix), F.lit(False))
    return F.arrays_overlap(s, any_of(P.PERSISTENCE_SEGMENTS)) | ends


def is_contract(path: Column) -> Column:
    return F.arrays_overlap(segments(path), any_of(P.CONTRACT_SEGMENTS))


def role(text: Column) -> Column:
    """Role named by the first list with a substring of the text."""
    hay = F.lower(F.coalesce(text, F.lit("")))
    return first_match({k: hay.rlike("|".join(v)) for k, v in P.ROLE_WORDS.items()}, "internal")


def domain(token_array: Column) -> Column:
    """Domain with the most keywords among the tokens; ties to the lesser name; general without any."""
    scores = F.array(*[F.struct((-F.size(F.array_intersect(token_array, any_of(v)))).alias("s"), F.lit(k).alias("d")) for k, v in P.DOMAIN_KEYWORDS.items()])
    best = F.array_min(scores)
    return F.when(best["s"] < 0, best["d"]).otherwise("general")


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def log_share(v: Column, most: Column) -> Column:
    """ln(1+v)/ln(1+most), 0 where either is not positive."""
    return F.when((v <= 0) | (most <= 0), 0.0).otherwise(F.log(1.0 + v) / F.log(1.0 + most))


def entrypoint_reasons(path: Column, explicit: Column, main_guard: Column, symbols: Column) -> Column:
    """Ordered reasons why a file is an entrypoint."""
    s = segments(path)
    return F.array_compact(
        F.array(
            F.when(explicit, "explicit_config"),
            F.when(F.get(s, F.size(s) - 1).isin(*P.ENTRYPOINT_FILES), "filename_heuristic"),
            F.when(main_guard, "main_guard"),
            F.when(F.array_contains(symbols, "main"), "main_symbol"),
            F.when(F.array_contains(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), "scripts"), "scripts_directory"),
        )
    )


def file_name(path: Column) -> Column:
    return F.coalesce(F.substring_index(F.lower(normalize_path(path)), "/", -1), F.lit(""))


def is_test(path: Column) -> Column:
    p, name = F.lower(normalize_path(path)), file_name(path)
    return p.startswith("tests/") | name.startswith("test_") | name.endswith("_test.py")


def is_excluded_seed(path: Column) -> Column:
    """Paths that never seed a scenario: none, generated, installed, package and test files."""
    p = F.lower(normalize_path(path))
    return (p == "") | p.startswith("<") | p.rlike("(site|dist)-packages/") | p.endswith("/__init__.py") | p.rlike("(^|/)(tests/|test_)") | p.endswith("_test.py")


def is_private(name: Column) -> Column:
    n = F.trim(F.coalesce(name, F.lit("")))
    return (n == "") | n.startswith("_") | n.startswith("test")


def imports_any(imports: Column, packages: tuple[str, ...]) -> Column:
    """Whether an import is one of the packages or below one."""
    return F.coalesce(F.exists(imports, lambda i: F.substring_index(i, ".", 1).isin(*packages)), F.lit(False))


def is_web_router(imports: Column) -> Column:
    return imports_any(imports, P.WEB_PACKAGES)


def is_cli_module(path: Column, imports: Column) -> Column:
    return F.contains(file_name(path), F.lit("cli")) | F.lower(normalize_path(path)).startswith("scripts/") | imports_any(imports, P.CLI_PACKAGES)


def is_below(path: Column, roots: tuple[str, ...]) -> Column:
    """Whether a path, or the path of a node id, is below one of the roots."""
    bare = F.regexp_replace(F.regexp_replace(normalize_path(path), "^canonical://[^/]+/", ""), "^[a-z]+:", "")
    out = F.lit(False)
    for r in roots:
        out = out | bare.startswith(r.rstrip("/") + "/")
    return out


def file_category(path: Column, package: str, domains: tuple[str, ...]) -> Column:
    """Taxonomy of a repository's files: package_root, domain, misplaced, tooling or orphan."""
    parts = F.split(path, "/")
    top, second = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    root = (F.size(parts) == 2) & second.isin("__init__.py", "__main__.py", "cli.py")
    inside = F.when(root, "package_root").when(second.isin(*domains), "domain").otherwise("misplaced")
    return F.when(top == package, inside).when(top == "tests", "domain").when(top == "tools", "tooling").otherwise("orphan")


def absolute_import(name: Column, module: Column, package: Column) -> Column:
    """An import as a full dotted name.  Leading dots lead from the importing module's package
    (package: whether the module is one itself) upwards; null where they lead above the top."""
    level = F.length(name) - F.length(F.ltrim(name, F.lit(".")))
    rest = F.nullif(F.ltrim(name, F.lit(".")), F.lit(""))
    parts = F.split(module, r"\.")
    keep = F.size(parts) - level + F.when(package, 1).otherwise(0)
    base = F.nullif(F.array_join(F.slice(parts, 1, F.greatest(keep, F.lit(0))), "."), F.lit(""))
    return F.when(level == 0, name).when(keep >= 0, F.nullif(F.concat_ws(".", base, rest), F.lit("")))


def legacy_id(canonical: Column) -> Column:
    """canonical://kind/path[/name] -> kind:path[:name]; files have no name; null if it is no such id."""
    kind, rest = F.regexp_extract(canonical, "^canonical://(file|function|class)/(.+)$", 1), F.regexp_extract(canonical, "^canonical://(file|function|class)/(.+)$", 2)
    named = F.concat_ws(":", kind, F.regexp_replace(rest, "/[^/]*$", ""), F.regexp_extract(rest, "([^/]*)$", 1))
    return F.when(kind == "file", F.concat_ws(":", kind, rest)).when((kind != "") & F.contains(rest, F.lit("/")), named)


def canonical_of(node: Column) -> Column:
    """A node id of either form as a trimmed canonical id; null for anything else."""
    text = F.trim(F.coalesce(node, F.lit("")))
    kind, path, name = (F.regexp_extract(text, "^(file|function|class):([^:]+)(?::(.+))?$", i) for i in (1, 2, 3))
    made = canonical_id(kind, path, name)
    whole = text.rlike("^canonical://(file|function|class)/.+$")
    return F.when(whole, text).when((kind != "") & ((kind == "file") | (name != "")), made)


def normalized_id(node: Column) -> Column:
    """A node id of either form, normalised, and why it is none: struct (id, reason).

    canonical://kind/path[/name] and kind:path[:name] keep their form; kinds are file, function
    and class in any case, paths are normalised, and function and class need a name, which
    stands behind the last separator.  id is empty where reason is not: blank, no_kind (neither
    form), unknown_kind, no_path, no_name.
    """
    text = F.trim(F.coalesce(node.cast("string"), F.lit("")))
    canonical = text.startswith("canonical://")
    rest = F.when(canonical, F.substring(text, 13, F.length(text))).otherwise(text)
    separator = F.when(canonical, "/").otherwise(":")
    at = F.call_function("instr", rest, separator)
    kind = F.lower(F.trim(F.substring(rest, 1, F.greatest(at - 1, F.lit(0)))))
    payload = F.trim(F.substring(rest, at + 1, F.length(rest)))
    # The name stands behind the last separator, and may be missing.
    last = F.when(canonical, F.substring_index(payload, "/", -1)).otherwise(F.substring_index(payload, ":", -1))
    name = F.trim(last)
    named = F.call_function("instr", payload, separator) > 0
    path = normalize_path(F.when(kind == "file", payload).when(named, F.substring(payload, 1, F.length(payload) - F.length(last) - 1)))
    needs_name = kind.isin("function", "class")
    reason = (
        F.when(text == "", "blank")
        .when(at == 0, "no_kind")
        .when(~kind.isin("file", "function", "class"), "unknown_kind")
        .when(needs_name & (~named | (name == "")), "no_name")
        .when(path == "", "no_path")
        .otherwise("")
    )
    parts = [kind, path, F.when(needs_name, name)]
    made = F.when(canonical, F.concat(F.lit("canonical://"), F.concat_ws("/", *parts))).otherwise(F.concat_ws(":", *parts))
    return F.struct(F.when(reason == "", made).otherwise("").alias("id"), reason.alias("reason"))


def node_path(canonical: Column) -> Column:
    """The file path of a canonical id; null for other text."""
    kind, rest = F.regexp_extract(canonical, "^canonical://(file|function|class)/(.+)$", 1), F.regexp_extract(canonical, "^canonical://(file|function|class)/(.+)$", 2)
    return F.when(kind == "file", rest).when((kind != "") & F.contains(rest, F.lit("/")), F.regexp_replace(rest, "/[^/]*$", ""))


def flag(value: Column) -> Column:
    """true, yes, y, on and 1 in any case are true, everything else is false."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "yes", "y", "on", "1"), F.lit(False))


def _finite(value: Column) -> Column:
    x = F.trim(value.cast("string")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def number(value: Column, otherwise: float = 0.0) -> Column:
    """A finite double of any text, else the default."""
    return F.coalesce(_finite(value), F.lit(float(otherwise)))


def whole_number(value: Column, otherwise: int = 0) -> Column:
    """The integer part of a finite number of any text, else the default."""
    return F.coalesce(_finite(value).cast("long"), F.lit(otherwise))


def node_flag(names: tuple[str, ...], field: Column, metadata: Column, tags: Column, role: Column) -> Column:
    """Whether a node is marked by a field of its own, one of the names in its metadata (a
    map of strings), its tags or its role."""
    wanted = any_of(names)
    marked = F.exists(wanted, lambda n: flag(F.try_element_at(metadata, n)))
    tagged = F.arrays_overlap(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), wanted)
    return flag(field) | F.coalesce(marked, F.lit(False)) | F.coalesce(tagged, F.lit(False)) | F.coalesce(F.lower(F.trim(role)).isin(*names), F.lit(False))


def sorted_json(pairs: Column) -> Column:
    """A map of strings as JSON text with sorted keys, and so equal for equal maps."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


def encoded_json(pairs: Column) -> Column:
    """sorted_json in URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.base64(F.encode(sorted_json(pairs), "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def content_key(pairs: Column) -> Column:
    """SHA-256 of sorted_json."""
    return F.sha2(sorted_json(pairs), 256)


def utc_stamp(ts: Column) -> Column:
    """2024-01-31T23:59:59Z of a timestamp, in UTC."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def merged(first: Column, second: Column) -> Column:
    """Two maps of strings as one; of a key in both the second one's value holds."""
    mine = F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(second), k))
    return F.when(first.isNull(), second).when(second.isNull(), first).otherwise(F.map_concat(mine, second))
