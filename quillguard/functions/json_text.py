"""JSON documents as text: read token by token, so that no schema is asked for and whatever is not
edited stays as it was written. Composed as SQL text, as in ``spans``."""

from __future__ import annotations

from collections.abc import Callable

from quillguard.functions.spans import Sql, fresh, let, lit

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
# keys with their colon, other strings, and all that lies between strings
_PIECES = rf'(?s){_STRING}(?:\s*+:\s*+)?|[^"]++'
_TOKENS = rf'(?s){_STRING}|[{{}}\[\],:]|[^"{{}}\[\],:]++'
_SPAN = "struct<path:string,start:int,end:int>"
_STATE = (
    f"struct<pos:int,key:string,open:array<struct<path:string,start:int,object:boolean>>,found:array<{_SPAN}>>"
)


def is_document(text: Sql) -> Sql:
    """True for one JSON object, array or string, without repeated keys and with nothing behind it
    (a parser alone stops at the end of the first value). A bare number is text."""
    one = f"to_json(try_parse_json(concat('[', {text}, ']')))"
    return (
        f"({text} RLIKE {lit(chr(92) + 'A' + chr(92) + 's*[{' + chr(92) + '[' + chr(34) + ']')} AND "
        f"coalesce({one} = concat('[', to_json(try_parse_json({text})), ']'), false))"
    )


def string_value(literal: Sql) -> Sql:
    """What a JSON string literal stands for."""
    return (
        f"CASE WHEN contains({literal}, {lit(chr(92))}) THEN CAST(try_parse_json({literal}) AS STRING) "
        f"ELSE substring({literal}, 2, length({literal}) - 2) END"
    )


def string_literal(value: Sql) -> Sql:
    return f"to_json(CAST({value} AS VARIANT))"


def edit_strings(doc: Sql, edit: Callable[[Sql, Sql], Sql], reasons: Sql) -> Sql:
    """``struct(v, r)`` of a document: ``edit(value, key)`` gives ``struct(v, r)`` for each string
    that is a value, with a null ``v`` where the string stays; ``key`` is null inside arrays.
    ``reasons`` is the empty list of them."""

    def on_pieces(pieces: Sql) -> Sql:
        piece, i = fresh("p"), fresh("i")
        before = f"get({pieces}, {i} - 1)"
        # a key ends in its colon, a stretch between strings does not start with a quote
        is_key = f"startswith({before}, '\"') AND NOT endswith({before}, '\"')"
        key = f"CASE WHEN {is_key} THEN {string_value(f'regexp_extract({before}, {lit(_STRING)}, 0)')} END"

        def edited(key: Sql) -> Sql:
            return let(
                edit(string_value(piece), key),
                lambda e: f"named_struct('v', CASE WHEN {e}.v IS NULL THEN {piece} ELSE {string_literal(f'{e}.v')} END, 'r', {e}.r)",
            )

        is_value = f"startswith({piece}, '\"') AND endswith({piece}, '\"')"
        done = (
            f"transform({pieces}, ({piece}, {i}) -> CASE WHEN {is_value} THEN {let(key, edited)} "
            f"ELSE named_struct('v', {piece}, 'r', {reasons}) END)"
        )
        return let(
            done,
            lambda d: f"named_struct('v', array_join(transform({d}, x -> x.v), ''), 'r', flatten(transform({d}, x -> x.r)))",
        )

    return let(f"regexp_extract_all({doc}, {lit(_PIECES)}, 0)", on_pieces)


def locate(doc: Sql, paths: Sql) -> Sql:
    """Spans of the values that ``paths`` (such as ``$.a.b``) name, in code points. One pass keeps the
    open containers and the spans asked for. Dots part the keys, so a key with a dot has no path, and
    neither has anything inside an array."""
    acc, t = fresh("a"), fresh("t")
    end = f"{acc}.pos + length({t})"
    top = f"try_element_at({acc}.open, -1)"
    here = (
        f"CASE WHEN size({acc}.open) = 0 THEN '$' WHEN {top}.object AND NOT contains({acc}.key, '.') "
        f"THEN concat({top}.path, '.', {acc}.key) END"
    )

    def state(key: Sql, open_: Sql, found: Sql) -> Sql:
        return f"CAST(named_struct('pos', {end}, 'key', {key}, 'open', {open_}, 'found', {found}) AS {_STATE})"

    def with_span(path: Sql, start: Sql) -> Sql:
        span = f"CAST(named_struct('path', {path}, 'start', {start}, 'end', {end}) AS {_SPAN})"
        return f"CASE WHEN array_contains({paths}, {path}) THEN array_append({acc}.found, {span}) ELSE {acc}.found END"

    same = (f"{acc}.open", f"{acc}.found")
    pushed = f"array_append({acc}.open, named_struct('path', {here}, 'start', {acc}.pos, 'object', {t} = '{{'))"
    popped = f"slice({acc}.open, 1, greatest(size({acc}.open) - 1, 0))"
    step = (
        f"CASE WHEN {t} IN ('{{', '[') THEN {state('NULL', pushed, same[1])} "
        f"WHEN {t} IN ('}}', ']') THEN {state('NULL', popped, with_span(f'{top}.path', f'{top}.start'))} "
        f"WHEN {t} IN (',', ':') OR {t} RLIKE {lit(chr(92) + 'A' + chr(92) + 's*' + chr(92) + 'z')} "
        f"THEN {state(f'{acc}.key', *same)} "
        f"WHEN startswith({t}, '\"') AND coalesce({top}.object, false) AND {acc}.key IS NULL "
        f"THEN {state(string_value(t), *same)} "
        f"ELSE {state('NULL', same[0], with_span(here, f'{acc}.pos'))} END"
    )
    start = f"CAST(named_struct('pos', 0, 'key', NULL, 'open', array(), 'found', array()) AS {_STATE})"
    return (
        f"aggregate(regexp_extract_all({doc}, {lit(_TOKENS)}, 0), {start}, ({acc}, {t}) -> {step}, z -> z.found)"
    )
