"""Registered queries over documents: programs of both languages with dynamic values, each beside its SQL.

Documents are made from the rows of a table by Spark SQL; the result is the key columns and ``v``, the program's one output.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.api import jq_documents, yq_documents

#: A nation as a nested object.
NATION = "to_json(named_struct('a', n_nationkey, 'b', named_struct('c', n_regionkey), 'n', n_name))"


@dataclass
class DocumentQuery:
    program: str
    want: str  # the output, in SQL
    cast: str = "long"
    doc: str = NATION
    table: str = "nation"
    keep: tuple[str, ...] = ("n_nationkey",)
    language: str = "jq"
    formats: tuple[str, str] = ("json", "json")

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{self.table}.parquet").select(*self.keep, F.expr(self.doc).alias("doc"))
        spread = spark.sparkContext.defaultParallelism
        if self.language == "jq":
            out = jq_documents(rows, "doc", self.program, keep=list(self.keep), spread=spread)
            value = F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v")
        else:
            out = yq_documents(rows, "doc", self.program, *self.formats, keep=list(self.keep), spread=spread)
            value = F.regexp_replace("value", "\n+$", "")
            if self.formats[1] == "json":
                value = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
        return out.select(*self.keep, F.coalesce(value, F.col("error")).cast(self.cast).alias("v"))

    def sql(self) -> str:
        return f"SELECT {', '.join(self.keep)}, {self.want} AS v FROM {self.table}"


def _yq(program: str, want: str, cast: str = "long", doc: str = NATION, formats: tuple[str, str] = ("json", "json"), **more) -> DocumentQuery:
    return DocumentQuery(program, want, cast, doc, language="yq", formats=formats, **more)


_K, _R, _N = "n_nationkey", "n_regionkey", "n_name"
_ORDER = {"table": "orders", "keep": ("o_orderkey",), "doc": "to_json(named_struct('d', date_format(o_orderdate, 'yyyy-MM-dd'), 'v', o_totalprice))"}

QUERIES: dict[str, DocumentQuery] = {
    # ---- paths and updates
    "paths_getpath": DocumentQuery("[paths(numbers) as $p | getpath($p)] | add", f"{_K} + {_R}"),
    "leaf_paths_count": DocumentQuery("([leaf_paths] | length) * .a", f"3 * {_K}"),
    "path_expression": DocumentQuery("[path(.b.c, .n)] | map(join(\"/\")) | join(\" \")", "'b/c n'", "string"),
    "setpath_delpaths": DocumentQuery('setpath(["b", "d"]; 5) | delpaths([["a"]]) | [.. | numbers] | add', f"{_R} + 5"),
    "update_nested": DocumentQuery(".b.c |= . * 2 | .b.e += 3 | .b.c + .b.e", f"2 * {_R} + 3"),
    "update_alternative": DocumentQuery(".z //= .a | .z", _K),
    "slice_assignment": DocumentQuery("[range(.a + 5)] | .[1:3] = [9] | length", f"{_K} + 4"),
    "del_paths": DocumentQuery("del(.b.c, .n) | [.. | scalars] | add", _K),
    "pick_nested": DocumentQuery("pick(.b.c) | [paths] | length", "2"),
    "map_values_object": DocumentQuery("{a, c: .b.c} | map_values(. + 1) | add", f"{_K} + {_R} + 2"),
    "walk_numbers": DocumentQuery('walk(if type == "number" then . + 1 else . end) | .a + .b.c', f"{_K} + {_R} + 2"),
    "stream_round_trip": DocumentQuery("fromstream(tostream) == .", "true", "boolean"),
    "truncate_stream": DocumentQuery("[1 | truncate_stream(. as $d | {\"x\": {\"y\": 1}} | tostream)] | length", "2"),
    # ---- control
    "recurse_numbers": DocumentQuery("[recurse | numbers] | max", f"greatest({_K}, {_R})"),
    "recurse_condition": DocumentQuery("[.a | recurse(if . > 0 then . - 1 else empty end)] | length", f"{_K} + 1"),
    "label_break": DocumentQuery(".a as $a | [label $out | range(100) | if . >= $a then ., break $out else . end] | length", f"{_K} + 1"),
    "while_steps": DocumentQuery(".a | [while(. > 0; . - 3)] | length", f"CAST(ceil({_K} / 3.0) AS BIGINT)"),
    "until_limit": DocumentQuery(".a | until(. >= 25; . + 5)", f"CASE WHEN {_K} >= 25 THEN {_K} ELSE {_K} + 5 * CAST(ceil((25 - {_K}) / 5.0) AS BIGINT) END"),
    "repeat_limit": DocumentQuery(".a | [limit(3; repeat(. + 1))] | length", "3"),
    "try_catch_error": DocumentQuery('try (if .a % 2 == 0 then error("even") else "odd" end) catch .', f"CASE WHEN {_K} % 2 = 0 THEN 'even' ELSE 'odd' END", "string"),
    "error_suppressed": DocumentQuery("[.a[]?, .b.c] | length", "1"),
    "destructuring_alternatives": DocumentQuery(".b as [$x] ?// {c: $x} | $x", _R),
    "reduce_object": DocumentQuery('reduce range(.a) as $i ({}; .["k\\($i % 3)"] += 1) | length', f"least(3, {_K})"),
    "foreach_running": DocumentQuery("last(foreach range(.a) as $i (0; . + $i)) // 0", f"{_K} * ({_K} - 1) // 2"),
    "foreach_extract": DocumentQuery("[foreach range(.a) as $i (0; . + 1; select(. % 2 == 0))] | length", f"{_K} // 2"),
    "limit_first_nth": DocumentQuery("[limit(3; range(.a))] + [first(range(5; 9))] + [nth(2; range(7))] | add", f"(least(3, {_K}) * (least(3, {_K}) - 1)) // 2 + 7"),
    "skip_last": DocumentQuery("[skip(2; range(.a))] | length", f"greatest(0, {_K} - 2)"),
    "isempty_range": DocumentQuery("isempty(range(.a))", f"{_K} = 0", "boolean"),
    "any_all_generators": DocumentQuery("[any(range(.a); . > 5), all(range(.a); . < 9)] | map(tostring) | join(\",\")", f"CAST({_K} > 6 AS VARCHAR) || ',' || CAST({_K} <= 9 AS VARCHAR)", "string"),
    "recursive_function": DocumentQuery("def f(n): if n <= 1 then 1 else f(n - 1) * 2 end; f(.a % 10)", f"CAST(pow(2, greatest(({_K} % 10) - 1, 0)) AS BIGINT)"),
    "location": DocumentQuery("$__loc__.line + .a", f"1 + {_K}"),
    # ---- collections
    "combinations_product": DocumentQuery("[[range(.a % 4)], [range(2)]] | [combinations] | length", f"2 * ({_K} % 4)"),
    "combinations_power": DocumentQuery(".a as $a | ([[0, 1] | combinations(3)] | length) + $a", f"8 + {_K}"),
    "transpose_rows": DocumentQuery("[[.a, 1], [.b.c, 2]] | transpose | .[0] | add", f"{_K} + {_R}"),
    "bsearch_place": DocumentQuery(".a as $a | [range(0; 50; 2)] | bsearch($a)", f"CASE WHEN {_K} % 2 = 0 THEN {_K} // 2 ELSE -1 - ({_K} + 1) // 2 END"),
    "group_by_array": DocumentQuery("[range(.a)] | group_by(. % 3) | map(length) | max // 0", f"CAST(ceil({_K} / 3.0) AS BIGINT)"),
    "unique_by_array": DocumentQuery("[range(.a)] | unique_by(. % 4) | length", f"least(4, {_K})"),
    "min_max_by_array": DocumentQuery("[range(.a + 1)] | [min_by(-.), max_by(-.)] | .[0] - .[1]", _K),
    "reverse_sort_array": DocumentQuery("[range(.a + 1)] | reverse | [.[0], (sort | .[-1])] | add", f"2 * {_K}"),
    "flatten_depth": DocumentQuery("[[[.a]], [.b.c]] | [flatten(1), flatten] | map(length) | add", "4"),
    "array_difference": DocumentQuery("([range(.a)] - [range(5)]) | length", f"greatest(0, {_K} - 5)"),
    "indices_of": DocumentQuery('.n | indices("A") | length', f"length({_N}) - length(replace({_N}, 'A', ''))"),
    "index_rindex": DocumentQuery('.n | (index("A") // -1) + (rindex("A") // -1)', f"strpos({_N}, 'A') - 1 + CASE WHEN strpos({_N}, 'A') = 0 THEN -1 ELSE length({_N}) - strpos(reverse({_N}), 'A') END"),
    "index_stream": DocumentQuery("INDEX(range(.a); . % 3) | keys | length", f"least(3, {_K})"),
    "in_stream": DocumentQuery(".a | IN(range(0; 25; 5))", f"{_K} % 5 = 0", "boolean"),
    "join_stream": DocumentQuery('INDEX({"k": 1, "x": 7}, {"k": 2, "x": 9}; .k) as $t | [JOIN($t; range(.a % 4); tostring)] | map(.[1].x // 0) | add // 0', f"CASE {_K} % 4 WHEN 2 THEN 7 WHEN 3 THEN 16 ELSE 0 END"),
    "inside_contains": DocumentQuery('[([.a] | inside([range(10)])), (.n | contains("AN"))] | map(tostring) | join(",")', f"CAST({_K} < 10 AS VARCHAR) || ',' || CAST(contains({_N}, 'AN') AS VARCHAR)", "string"),
    "has_keys": DocumentQuery('[has("a", "z"), (keys | join("")), (keys_unsorted | length)] | map(tostring) | join(",")', "'true,false,abn,3'", "string"),
    "entries_round_trip": DocumentQuery('to_entries | from_entries | with_entries(.key |= ascii_upcase) | .A + .B.c', f"{_K} + {_R}"),
    "entries_of_array": DocumentQuery("[.a, .b.c, 3] | to_entries | map(.key * .value) | add", f"{_R} + 6"),
    "type_filters": DocumentQuery("[.[] | numbers, strings, objects, arrays, booleans, nulls, iterables] | length", "4"),
    "object_merge": DocumentQuery("({x: 1, y: {z: 2}} * {y: {w: .a}}) | [.. | numbers] | add", f"3 + {_K}"),
    # ---- strings
    "implode_reverse": DocumentQuery(".n | explode | reverse | implode", f"reverse({_N})", "string"),
    "trim_family": DocumentQuery('"  " + .n + " " | [trim, ltrim, rtrim, trimstr(" ")] | map(length) | add', f"4 * length({_N}) + 1 + 2 + 1"),
    "ltrimstr_rtrimstr": DocumentQuery('.n | ltrimstr("A") | rtrimstr("A")', f"regexp_replace(regexp_replace({_N}, '^A', ''), 'A$', '')", "string"),
    "split_regex": DocumentQuery('.n | (split("[AEIOU]"; null) | length) + ([splits("[AEIOU]")] | length)', f"2 * (length({_N}) - length(regexp_replace({_N}, '[AEIOU]', '', 'g')) + 1)"),
    "sub_captures": DocumentQuery('.n | sub("(?<x>[A-Z])"; "<\\(.x)>")', f"'<' || substr({_N}, 1, 1) || '>' || substr({_N}, 2)", "string"),
    "gsub_flags": DocumentQuery('.n | gsub("a"; "_"; "i")', f"regexp_replace({_N}, 'a', '_', 'gi')", "string"),
    "match_offsets": DocumentQuery('.n | [match("[AEIOU]"; "g").offset] | add // -1', f"coalesce(list_sum(list_filter(range(length({_N})), lambda i: substr({_N}, i + 1, 1) IN ('A', 'E', 'I', 'O', 'U'))), -1)"),
    "capture_scan": DocumentQuery('.n | [scan("[AEIOU]")] | join("")', f"regexp_replace({_N}, '[^AEIOU]', '', 'g')", "string"),
    "string_repeat": DocumentQuery('"ab" * (.a + 1) | length', f"2 * ({_K} + 1)"),
    "ascii_codes": DocumentQuery("[.n | explode[] | [.] | implode] | join(\"\") | utf8bytelength", f"length({_N})"),
    "format_json_text": DocumentQuery("[.n, .a] | @json", f"'[\"' || {_N} || '\",' || {_K} || ']'", "string"),
    "format_shell": DocumentQuery('@sh "echo \\(.n)"', f"'echo ''' || {_N} || ''''", "string"),
    "format_html": DocumentQuery('"<\\(.n)\'\\">" | @html', f"'&lt;' || {_N} || '&apos;&quot;&gt;'", "string"),
    "format_round_trips": DocumentQuery('.n | @base64 | @base64d | @base32 | @base32d | @uri | @urid', _N, "string"),
    "format_csv_tsv": DocumentQuery('[.a, .n] | @csv + "|" + @tsv', f"{_K} || ',\"' || {_N} || '\"|' || {_K} || chr(9) || {_N}", "string"),
    "conversions": DocumentQuery('[(.a | tostring | tonumber), (.b | tojson | fromjson | .c), ("true" | toboolean | if . then 1 else 0 end), ([.a] | toarray | length), (.a | toarray | length)] | add', f"{_K} + {_R} + 3"),
    # ---- numbers and dates
    "math_logs": DocumentQuery(".a + 1 | [log2, (log10 * 0), (exp2 | log2)] | add * 1000 | round", f"CAST(round((log2({_K} + 1) + {_K} + 1) * 1000) AS BIGINT)"),
    "math_gamma": DocumentQuery(".a + 1 | lgamma * 1000 | round", f"CAST(round(lgamma({_K} + 1) * 1000) AS BIGINT)"),
    "math_parts": DocumentQuery("[(.a | frexp | .[1]), (.a + 0.5 | modf | .[1]), ldexp(.a; 2), scalb(.a; 1), fma(.a; 2; 1)] | add", f"(CASE WHEN {_K} = 0 THEN 0 ELSE CAST(floor(log2({_K})) AS BIGINT) + 1 END) + {_K} + 4 * {_K} + 2 * {_K} + 2 * {_K} + 1"),
    "math_signs": DocumentQuery("[copysign(.a; -1), fdim(.a; 5), (-.a | abs), (.a / 2 | [ceil, floor, trunc] | add)] | add", f"CAST(greatest({_K} - 5, 0) + ceil({_K} / 2.0) + 2 * floor({_K} / 2.0) AS BIGINT)"),
    "number_tests": DocumentQuery("[(infinite | isinfinite), (nan | isnan), (.a | isnormal)] | map(if . then 1 else 0 end) | add", f"CASE WHEN {_K} = 0 THEN 2 ELSE 3 END"),
    "strptime_mktime": DocumentQuery('.d | strptime("%Y-%m-%d") | mktime', "CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT)", **_ORDER),
    "gmtime_yearday": DocumentQuery('.d + "T00:00:00Z" | fromdate | gmtime | .[7] + .[0]', "CAST(dayofyear(o_orderdate) - 1 + year(o_orderdate) AS BIGINT)", **_ORDER),
    "date_arithmetic": DocumentQuery('.d + "T00:00:00Z" | fromdateiso8601 | . + 86400 | todateiso8601', "strftime(date_trunc('day', o_orderdate) + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%SZ')", "string", **_ORDER),
    # ---- YAML expressions
    "yq_group_by": _yq("[.a, .b.c, 1] | group_by(.) | length", f"len(list_distinct([{_K}, {_R}, 1]))"),
    "yq_unique_sort": _yq("[.b.c, .a, .a] | unique | sort | .[-1]", f"greatest({_K}, {_R})"),
    "yq_min_max": _yq("[.a, .b.c] | (max - min)", f"abs({_K} - {_R})"),
    "yq_reduce": _yq("[.a, .b.c, 3] | .[] as $x ireduce (0; . + $x)", f"{_K} + {_R} + 3"),
    "yq_pivot": _yq('[{"x": .a, "y": 1}, {"x": .b.c}] | pivot | .x | (.[0] + .[1])', f"{_K} + {_R}"),
    "yq_merge": _yq('. * {"b": {"d": 4}} | .b.c + .b.d', f"{_R} + 4"),
    "yq_map_filter": _yq("[.a, .b.c] | map(. + 1) | filter(. > 3) | length", f"CASE WHEN {_K} > 2 THEN 1 ELSE 0 END + CASE WHEN {_R} > 2 THEN 1 ELSE 0 END"),
    "yq_entries": _yq('.b | with_entries(.key |= "x_" + .) | .x_c', _R),
    "yq_keys_flatten": _yq('[keys, ["q"]] | flatten | join(",")', "'a,b,n,q'", "string"),
    "yq_strings": _yq('.n | downcase | split("a") | join("-")', f"replace(lower({_N}), 'a', '-')", "string"),
    "yq_regex": _yq('.n | [match("[AEIOU]"; "g")] | length', f"length({_N}) - length(regexp_replace({_N}, '[AEIOU]', '', 'g'))"),
    "yq_capture": _yq('.n | capture("^(?P<x>.)(?P<rest>.*)$") | .rest', f"substr({_N}, 2)", "string"),
    "yq_alternative_if": _yq('if .a > 10 then (.z // "big") else "small" end', f"CASE WHEN {_K} > 10 THEN 'big' ELSE 'small' END", "string"),
    "yq_recursive_descent": _yq('[.. | select(tag == "!!int")] | length', "2"),
    "yq_paths": _yq('.b.c | path | join(".")', "'b.c'", "string"),
    "yq_update_all": _yq('(.. | select(tag == "!!int")) |= . + 1 | .a + .b.c', f"{_K} + {_R} + 2"),
    "yq_delete": _yq("del(.b.c) | .b | length", "0"),
    "yq_sort_keys": _yq("sort_keys(..) | keys | .[0]", "'a'", "string"),
    "yq_array_to_map": _yq('["x", .n] | array_to_map | .[1]', _N, "string"),
    "yq_any_all": _yq('[.a > 3, .b.c < 2] | any', f"{_K} > 3 OR {_R} < 2", "boolean"),
    "yq_first_reverse": _yq("[.a, .b.c] | reverse | first", _R),
    "yq_slice": _yq("[.a, .b.c, 9] | .[1:] | length", "2"),
    "yq_variables": _yq(".a as $x | .b.c as $y | $x * 100 + $y", f"{_K} * 100 + {_R}"),
    "yq_date_format": _yq('.d + "T00:00:00Z" | format_datetime("2006/01/02")', "strftime(o_orderdate, '%Y/%m/%d')", "string", _ORDER["doc"], table="orders", keep=("o_orderkey",)),
    "yq_unix_time": _yq('.a * 86400 | from_unix | tz("UTC") | to_unix', f"{_K} * 86400"),
    "yq_anchors": _yq("explode(.) | .d.x + .d.y", f"{_K} + 1", doc="concat('b: &b\\n  x: ', n_nationkey, '\\n  y: 0\\nd:\\n  <<: *b\\n  y: 1\\n')", formats=("yaml", "json")),
    "yq_comments": _yq(".a | line_comment", _N, "string", "concat('a: 1 # ', n_name, '\\n')", ("yaml", "yaml")),
    "yq_comment_kept": _yq(".a += 1", f"'a: ' || ({_K} + 1) || ' # x'", "string", "concat('a: ', n_nationkey, ' # x\\n')", ("yaml", "yaml")),
    # ---- formats
    "read_yaml": _yq(".a.b[1]", _K, doc="concat('a:\\n  b:\\n    - 0\\n    - ', n_nationkey, '\\n')", formats=("yaml", "json")),
    "read_csv": _yq(".[0].name", _N, "string", "concat('k,name\\n', n_nationkey, ',\"', n_name, '\"\\n')", ("csv", "json")),
    "read_tsv": _yq(".[0].k + 1", f"{_K} + 1", doc="concat('k\\tname\\n', n_nationkey, '\\t', n_name, '\\n')", formats=("tsv", "json")),
    "read_xml": _yq('.n.k + "/" + .n."+@id"', f"{_K} || '/' || {_R}", "string", "concat('<n id=\"', n_regionkey, '\"><k>', n_nationkey, '</k></n>')", ("xml", "json")),
    "read_properties": _yq(".a.b", _N, "string", "concat('a.b = ', n_name, '\\n')", ("props", "json")),
    "read_toml": _yq(".t.k", _K, doc="concat('[t]\\nk = ', n_nationkey, '\\n')", formats=("toml", "json")),
    "read_hcl": _yq(".k", _K, doc="concat('k = ', n_nationkey, '\\n')", formats=("hcl", "json")),
    "read_lua": _yq(".k", _K, doc="concat('return {k = ', n_nationkey, '}')", formats=("lua", "json")),
    "read_base64": _yq(".", _N, "string", "base64(encode(n_name, 'utf-8'))", ("base64", "json")),
    "read_uri": _yq(".", f"{_N} || ' &'", "string", "concat(replace(n_name, ' ', '%20'), '%20%26')", ("uri", "json")),
    "write_yaml": _yq('{"k": .a, "l": [.b.c]}', f"'k: ' || {_K} || chr(10) || 'l:' || chr(10) || '  - ' || {_R}", "string", formats=("json", "yaml")),
    "write_csv": _yq('[{"k": .a, "n": .n}]', f"'k,n' || chr(10) || {_K} || ',' || {_N}", "string", formats=("json", "csv")),
    "write_properties": _yq('{"k": .b}', f"'k.c = ' || {_R}", "string", formats=("json", "props")),
    "write_toml": _yq('{"k": .a}', f"'k = ' || {_K}", "string", formats=("json", "toml")),
    "write_xml": _yq('{"k": .a}', f"'<k>' || {_K} || '</k>'", "string", formats=("json", "xml")),
    "write_shell": _yq('{"k": .a}', f"'k=' || {_K}", "string", formats=("json", "shell")),
    "write_base64": _yq(".n", f"base64(encode({_N}))", "string", formats=("json", "base64")),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql() for name, q in QUERIES.items()}
