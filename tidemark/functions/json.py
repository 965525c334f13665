"""JSON access, construction, differences and shapes.

Access and construction are built-in expressions. What Spark has no expression for (RFC 6902 differences,
patches, pointers, YAML, templates) runs as Arrow-batched functions. A text that is not JSON gives null.
"""

from __future__ import annotations

import json as std
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import PandasUDFType

PLAIN_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def path_of(key: str) -> str:
    """A path to one key; anything but a plain name is put in brackets with single quotes."""
    if PLAIN_KEY.fullmatch(key):
        return f"$.{key}"
    if "'" in key:
        raise ValueError(f"a key with a quote can't be addressed: {key!r}")
    return f"$['{key}']"


def field(value: Column | str, key: str) -> Column:
    """The text of one key (``->>``)."""
    return F.get_json_object(F.col(value) if isinstance(value, str) else value, path_of(key))


def fields(value: Column | str, paths: dict[str, str]) -> list[Column]:
    """Several paths at once, each under its name."""
    column = F.col(value) if isinstance(value, str) else value
    return [F.get_json_object(column, path).alias(name) for name, path in paths.items()]


def json_rows(df: DataFrame, payload: str, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """A JSON array of objects as rows of text columns (nested values as JSON text); a missing key is null."""
    each = df.select(*(keep or []), F.explode(F.from_json(payload, "array<string>")).alias("__row"))
    return each.select(*(keep or []), *[field("__row", n).alias(n) for n in names])


def each_value(df: DataFrame, payload: str, path: str, keep: list[str] | None = None) -> DataFrame:
    """``ordinal``, ``value`` of an array at a path, from 1."""
    items = F.from_json(F.get_json_object(payload, path), "array<string>")
    return df.select(*(keep or []), F.posexplode(items).alias("__at", "value")).select(*(keep or []), (F.col("__at") + 1).alias("ordinal"), "value")


def is_valid(value: Column | str) -> Column:
    return F.try_parse_json(value).isNotNull()


def object_of(**columns: Column) -> Column:
    """A JSON object that keeps its null members."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]), {"ignoreNullFields": "false"})


def array_of(*columns: Column) -> Column:
    return F.to_json(F.array(*columns))


def envelope(header: list[str], rows: Column) -> Column:
    """A relation tunnelled through one text as {header, body}; ``rows`` is an array of arrays of texts."""
    return F.to_json(F.struct(F.array(*[F.lit(h) for h in header]).alias("header"), rows.alias("body")))


def open_envelope(df: DataFrame, payload: str, keep: list[str] | None = None) -> DataFrame:
    """``ordinal`` and a map from header to text for each body row of {header, body} texts."""
    whole = F.from_json(payload, "struct<header:array<string>,body:array<array<string>>>")
    rows = df.select(*(keep or []), whole.alias("__e")).select(*(keep or []), "__e.header", F.posexplode("__e.body").alias("__at", "__row"))
    return rows.select(*(keep or []), (F.col("__at") + 1).alias("ordinal"), F.map_from_arrays("header", "__row").alias("row"))


def unzip_rows(df: DataFrame, keep: list[str], arrays: dict[str, str]) -> DataFrame:
    """Parallel arrays as rows with ``ordinal`` from 1; arrays that are shorter give nulls."""
    zipped = F.arrays_zip(*arrays)
    rows = df.select(*keep, F.posexplode(zipped).alias("__at", "__z"))
    return rows.select(*keep, (F.col("__at") + 1).alias("ordinal"), *[F.col(f"__z.{a}").alias(n) for a, n in arrays.items()])


def zip_rows(df: DataFrame, keep: list[str], columns: dict[str, str], order: str = "ordinal") -> DataFrame:
    """Rows as parallel arrays in order: the inverse of :func:`unzip_rows`."""
    gathered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *[F.col(c) for c in columns])))
    rows = df.groupBy(*keep).agg(gathered.alias("__all"))
    return rows.select(*keep, *[F.transform("__all", element(c)).alias(n) for c, n in columns.items()])


def element(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


def to_entries(value: Column | str) -> Column:
    """A map (or an object's text) as an array of (key, value)."""
    return F.map_entries(F.from_json(value, "map<string,string>"))


def from_entries(entries: Column | str) -> Column:
    return F.to_json(F.map_from_entries(entries))


# Plain functions over values, and Arrow-batched columns made of them.


def pointer(*parts: object) -> str:
    return "".join("/" + str(p).replace("~", "~0").replace("/", "~1") for p in parts)


def parts_of(path: str) -> list[str]:
    return [p.replace("~1", "/").replace("~0", "~") for p in path.split("/")[1:]]


def diff_value(a: object, b: object, at: tuple = ()) -> list[dict]:
    """RFC 6902 operations that make ``b`` of ``a``: object members by name, arrays by place."""
    if type(a) is type(b) and a == b:
        return []
    if isinstance(a, dict) and isinstance(b, dict):
        out = [{"op": "remove", "path": pointer(*at, k)} for k in sorted(a.keys() - b.keys())]
        out += [{"op": "add", "path": pointer(*at, k), "value": b[k]} for k in sorted(b.keys() - a.keys())]
        for k in sorted(a.keys() & b.keys()):
            out += diff_value(a[k], b[k], (*at, k))
        return out
    if isinstance(a, list) and isinstance(b, list):
        shared = min(len(a), len(b))
        out = [op for i in range(shared) for op in diff_value(a[i], b[i], (*at, i))]
        out += [{"op": "remove", "path": pointer(*at, i)} for i in range(len(a) - 1, shared - 1, -1)]
        return out + [{"op": "add", "path": pointer(*at, "-"), "value": v} for v in b[shared:]]
    return [{"op": "replace", "path": pointer(*at), "value": b}]


def patch_value(value: object, operations: list[dict]) -> object:
    """A value after RFC 6902 operations; raises ValueError where one does not apply."""
    value = std.loads(std.dumps(value))
    for step in operations:
        op, path = step.get("op"), parts_of(step["path"])
        if op in ("move", "copy"):
            found = look_up(value, parts_of(step["from"]))
            if op == "move":
                value = change(value, parts_of(step["from"]), "remove", None)
            value = change(value, path, "add", std.loads(std.dumps(found)))
        elif op == "test":
            if look_up(value, path) != step.get("value"):
                raise ValueError(f"test failed at {step['path']}")
        elif op in ("add", "remove", "replace"):
            value = change(value, path, op, step.get("value"))
        else:
            raise ValueError(f"no such operation: {op}")
    return value


def look_up(value: object, path: list[str]) -> object:
    for part in path:
        try:
            value = value[int(part)] if isinstance(value, list) else value[part]
        except (KeyError, IndexError, TypeError) as error:
            raise ValueError(f"nothing at {pointer(*path)}") from error
    return value


def change(value: object, path: list[str], op: str, new: object) -> object:
    if not path:
        return None if op == "remove" else new
    holder, last = look_up(value, path[:-1]), path[-1]
    if isinstance(holder, list):
        at = len(holder) if last == "-" and op == "add" else int(last)
        if not 0 <= at < len(holder) + (op == "add"):
            raise ValueError(f"nothing at {pointer(*path)}")
        holder[at : at + (op != "add")] = [] if op == "remove" else [new]
    elif isinstance(holder, dict):
        if op != "add" and last not in holder:
            raise ValueError(f"nothing at {pointer(*path)}")
        if op == "remove":
            del holder[last]
        else:
            holder[last] = new
    else:
        raise ValueError(f"nothing at {pointer(*path)}")
    return value


def merge_value(value: object, patch: object) -> object:
    """A JSON merge patch (RFC 7396): null members are taken out."""
    if not isinstance(patch, dict):
        return patch
    out = dict(value) if isinstance(value, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_value(out.get(k), v)
    return out


def flatten_value(value: object, at: tuple = ()) -> dict[str, object]:
    """Leaves (and empty containers) by JSON pointer."""
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    if not isinstance(value, (dict, list)) or not value:
        return {pointer(*at): value}
    out: dict[str, object] = {}
    for k, v in items:
        out |= flatten_value(v, (*at, k))
    return out


def unflatten_value(flat: dict[str, object]) -> object:
    """The inverse of :func:`flatten_value`; a level whose keys are 0, 1, 2, ... becomes an array."""
    if set(flat) == {""}:
        return flat[""]
    root: dict = {}
    for path, leaf in flat.items():
        parts, at = parts_of(path), root
        for p in parts[:-1]:
            at = at.setdefault(p, {})
        at[parts[-1]] = ("leaf", leaf)

    def build(node: object) -> object:
        if isinstance(node, tuple):
            return node[1]
        made = {k: build(v) for k, v in node.items()}
        return [made[str(i)] for i in range(len(made))] if set(made) == {str(i) for i in range(len(made))} else made

    return build(root)


STEP = re.compile(r"\.?(?:(?P<name>[A-Za-z_][\w-]*|\"[^\"]+\")|\[(?P<index>-?\d+|\*)?\])")


def search_value(value: object, expression: str) -> object:
    """A subset of JMESPath: names, quoted names, indexes, ``[*]`` projections, ``[]`` flattening, ``|``, ``length(@)`` and ``keys(@)``."""
    for part in (p.strip() for p in expression.split("|")):
        if part in ("length(@)", "keys(@)"):
            value = len(value) if part[0] == "l" else sorted(value)
            continue
        value = walk(value, part if part != "@" else "")
    return value


def walk(value: object, rest: str) -> object:
    while rest:
        step = STEP.match(rest)
        if not step:
            raise ValueError(f"can't read {rest!r}")
        rest = rest[step.end() :]
        if step["name"]:
            name = step["name"].strip('"')
            value = value.get(name) if isinstance(value, dict) else None
        elif step["index"] not in (None, "*"):
            value = value[int(step["index"])] if isinstance(value, list) and -len(value) <= int(step["index"]) < len(value) else None
        else:
            items = value if isinstance(value, list) else []
            if step["index"] is None:
                items = [y for x in items for y in (x if isinstance(x, list) else [x])]
            return [y for y in (walk(x, rest) for x in items) if y is not None]
        if value is None:
            return None
    return value


TAG = re.compile(r"\{\{\s*(?P<show>[^}]+?)\s*\}\}|\{%\s*(?P<tag>[^%]+?)\s*%\}")


def render(template: str, data: object) -> str:
    """A small template language: ``{{ path }}``, ``{% for x in path %}``, ``{% if path %}``, ``{% else %}``, ``{% end... %}``; ``loop.index`` and ``loop.last``."""
    tokens, at = [], 0
    for tag in TAG.finditer(template):
        tokens.append(("text", template[at : tag.start()]))
        tokens.append(("show", tag["show"]) if tag["show"] else ("tag", tag["tag"]))
        at = tag.end()
    tokens.append(("text", template[at:]))
    out, rest = emit(tokens, 0, data, True)
    if rest != len(tokens):
        raise ValueError("an end without a beginning")
    return out


def scoped(scope: object, path: str) -> object:
    if path.startswith(("'", '"')):
        return path[1:-1]
    return search_value(scope, path)


def emit(tokens: list, at: int, scope: object, live: bool) -> tuple[str, int]:
    """Text up to the tag that ends this level, and that tag's place."""
    out = []
    while at < len(tokens):
        kind, value = tokens[at]
        if kind == "text":
            out.append(value if live else "")
        elif kind == "show":
            found = scoped(scope, value) if live else None
            out.append("" if found is None else found if isinstance(found, str) else std.dumps(found))
        elif value.startswith("for "):
            name, _, path = value[4:].partition(" in ")
            items = (scoped(scope, path.strip()) or []) if live else []
            end = at + 1
            for i, item in enumerate(items):
                inner = {**(scope if isinstance(scope, dict) else {}), name.strip(): item, "loop": {"index": i + 1, "last": i == len(items) - 1, "first": i == 0}}
                text, end = emit(tokens, at + 1, inner, live)
                out.append(text)
            if not items:
                _, end = emit(tokens, at + 1, scope, False)
            at = end
        elif value.startswith("if "):
            wanted, negated = value[3:].strip(), False
            if wanted.startswith("not "):
                wanted, negated = wanted[4:].strip(), True
            holds = live and bool(scoped(scope, wanted)) != negated
            text, end = emit(tokens, at + 1, scope, holds)
            out.append(text)
            if tokens[end][1] == "else":
                text, end = emit(tokens, end + 1, scope, live and not holds)
                out.append(text)
            at = end
        elif value == "else" or value.startswith("end"):
            return "".join(out), at
        else:
            raise ValueError(f"no such tag: {value}")
        at += 1
    return "".join(out), at


def batched(function: Callable[..., object], *columns: Column | str, kind: T.DataType | None = None) -> Column:
    """``function`` over the values of text columns, batch by batch; null where an argument is null or it raises ValueError."""
    kind = kind or T.StringType()

    def run(*series: pd.Series) -> pd.Series:
        def one(*values: object) -> object:
            if any(v is None for v in values):
                return None
            try:
                return function(*values)
            except ValueError:
                return None

        return pd.Series([one(*v) for v in zip(*series, strict=True)], dtype=object)

    run.__annotations__ = {}
    return F.pandas_udf(run, kind, PandasUDFType.SCALAR)(*columns)


def dumps(value: object) -> str:
    return std.dumps(value, sort_keys=True, ensure_ascii=False)


def json_diff(a: Column | str, b: Column | str) -> Column:
    return batched(lambda x, y: dumps(diff_value(std.loads(x), std.loads(y))), a, b)


def json_apply_patch(value: Column | str, patch: Column | str) -> Column:
    return batched(lambda x, y: dumps(patch_value(std.loads(x), std.loads(y))), value, patch)


def json_merge(value: Column | str, patch: Column | str) -> Column:
    return batched(lambda x, y: dumps(merge_value(std.loads(x), std.loads(y))), value, patch)


def json_flatten(value: Column | str) -> Column:
    return batched(lambda x: dumps(flatten_value(std.loads(x))), value)


def json_unflatten(value: Column | str) -> Column:
    return batched(lambda x: dumps(unflatten_value(std.loads(x))), value)


def json_search(value: Column | str, expression: str) -> Column:
    return batched(lambda x: dumps(search_value(std.loads(x), expression)), value)


def template_render(template: str, value: Column | str) -> Column:
    return batched(lambda x: render(template, std.loads(x)), value)


def yaml_to_json(value: Column | str) -> Column:
    def convert(text: str) -> str:
        import yaml

        try:
            return std.dumps(yaml.safe_load(text), sort_keys=True, ensure_ascii=False, default=str)
        except yaml.YAMLError as error:
            raise ValueError(str(error)) from error

    return batched(convert, value)
