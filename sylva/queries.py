"""Registered queries: filter programs over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva import document_queries
from sylva.api import jq, jq_documents, sort_keys, yq_documents
from sylva.sources.readers import events


@dataclass
class Query:
    table: str
    program: str
    sql: str | None
    mode: str = "slurp"
    order: tuple[str, ...] | None = None
    lookups: tuple[tuple[str, str, str], ...] = ()  # name, table, program that makes it
    rounded: tuple[str, ...] = ()

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        variables = {name: jq(read(t), program) if program != "." else read(t) for name, t, program in self.lookups}
        out = jq(read(self.table), self.program, self.mode, variables, list(self.order) if self.order else None)
        return out.withColumns({c: F.round(F.col(c), 4) for c in self.rounded}) if self.rounded else out


_ORD = ("o_orderkey",)
_EV = ("event_id",)
_ORDERS = (("orders", "orders", "."),)

QUERIES: dict[str, Query] = {
    # ---- groups
    "group_count_sum": Query("events", "group_by(.event_type) | map({event_type: .[0].event_type, n: length, total: (map(.value) | add)})",
        "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type", order=_EV, rounded=("total",)),
    "group_avg": Query("lineitem", "group_by(.l_returnflag) | map({flag: .[0].l_returnflag, mean: ((map(.l_quantity) | add) / length)})",
        "SELECT l_returnflag AS flag, round(sum(l_quantity) / count(*), 4) AS mean FROM lineitem GROUP BY 1", rounded=("mean",)),
    "group_min_max": Query("part", "group_by(.p_brand) | map({brand: .[0].p_brand, low: (map(.p_retailprice) | min), high: (map(.p_retailprice) | max)})",
        "SELECT p_brand AS brand, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY 1"),
    "group_multi_key": Query("lineitem", "group_by(.l_returnflag, .l_linestatus) | map({rf: .[0].l_returnflag, ls: .[0].l_linestatus, n: length, qty: (map(.l_quantity) | add), disc: (map(.l_extendedprice * (1 - .l_discount)) | add)})",
        "SELECT l_returnflag AS rf, l_linestatus AS ls, count(*) AS n, round(sum(l_quantity), 4) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS disc FROM lineitem GROUP BY 1, 2", rounded=("qty",)),
    "group_count_if": Query("orders", 'group_by(.o_orderpriority) | map({p: .[0].o_orderpriority, open: (map(select(.o_orderstatus == "O")) | length), large: (map(select(.o_totalprice > 200000) | .o_totalprice) | add)})',
        "SELECT o_orderpriority AS p, count(*) FILTER (o_orderstatus = 'O') AS open, round(sum(o_totalprice) FILTER (o_totalprice > 200000), 4) AS large FROM orders GROUP BY 1", rounded=("large",)),
    "group_distinct_count": Query("events", "group_by(.event_type) | map({t: .[0].event_type, users: (map(.user_id) | unique | length)})",
        "SELECT event_type AS t, count(DISTINCT user_id) AS users FROM events GROUP BY 1"),
    "group_lists": Query("nation", "group_by(.n_regionkey) | map({region: .[0].n_regionkey, names: (map(.n_name) | sort | join(\",\"))})",
        "SELECT n_regionkey AS region, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1", order=("n_nationkey",)),
    "conversation_turns": Query("conversations", "group_by(.conv_id) | map({conv_id: .[0].conv_id, turns: length, roles: ([.[] | .role] | join(\">\"))})",
        "SELECT conv_id, count(*) AS turns, string_agg(coalesce(role, ''), '>' ORDER BY turn, text) AS roles FROM conversations GROUP BY 1", order=("turn", "text")),
    "group_any_all": Query("orders", 'group_by(.o_custkey) | map({c: .[0].o_custkey, any_open: any(.o_orderstatus == "O"), all_big: all(.o_totalprice > 50000)})',
        "SELECT o_custkey AS c, bool_or(o_orderstatus = 'O') AS any_open, bool_and(o_totalprice > 50000) AS all_big FROM orders GROUP BY 1"),
    "group_first_last": Query("events", "group_by(.user_id) | map({u: .[0].user_id, first: .[0].event_id, last: .[-1].event_id})",
        "SELECT user_id AS u, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1", order=_EV),
    "group_of_groups": Query("lineitem", "group_by(.l_orderkey) | map({k: .[0].l_orderkey, n: length}) | group_by(.n) | map({lines: .[0].n, orders: length})",
        "SELECT n AS lines, count(*) AS orders FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1"),
    # ---- rows
    "select_filter": Query("lineitem", 'map(select(.l_quantity > 45 and .l_returnflag == "R")) | map({l_orderkey, l_linenumber, l_quantity})',
        "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'"),
    "project_object": Query("customer", ".[] | {id: .c_custkey, name: .c_name, rich: (.c_acctbal > 5000)}",
        "SELECT c_custkey AS id, c_name AS name, c_acctbal > 5000 AS rich FROM customer"),
    "map_arith": Query("lineitem", "map({k: .l_orderkey, n: .l_linenumber, net: (.l_extendedprice * (1 - .l_discount) * (1 + .l_tax))})",
        "SELECT l_orderkey AS k, l_linenumber AS n, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 4) AS net FROM lineitem", rounded=("net",)),
    "alternative_default": Query("labels", '.[] | {doc_id, q: (.quality // -1), t: (.toxic // -1)}',
        "SELECT doc_id, coalesce(quality, -1) AS q, coalesce(toxic, -1) AS t FROM labels"),
    "if_elif_else": Query("customer", '.[] | {c_custkey, tier: (if .c_acctbal < 0 then "debt" elif .c_acctbal < 5000 then "plain" else "gold" end)}',
        "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'plain' ELSE 'gold' END AS tier FROM customer"),
    "null_ordering_compare": Query("labels", "map(select(.toxic < 1)) | map({doc_id})", "SELECT doc_id FROM labels WHERE toxic < 1 OR toxic IS NULL"),
    "string_ops": Query("part", '.[] | {k: .p_partkey, up: (.p_name | ascii_upcase), n: (.p_name | length), head: (.p_name[:5]), std: (.p_type | startswith("STANDARD")), tail: (.p_type | endswith("STEEL"))}',
        "SELECT p_partkey AS k, upper(p_name) AS up, length(p_name) AS n, substr(p_name, 1, 5) AS head, starts_with(p_type, 'STANDARD') AS std, suffix(p_type, 'STEEL') AS tail FROM part"),
    "split_join": Query("part", '.[] | {k: .p_partkey, dashed: (.p_type | split(" ") | join("-")), words: (.p_type | split(" ") | length)}',
        "SELECT p_partkey AS k, replace(p_type, ' ', '-') AS dashed, CAST(len(string_split(p_type, ' ')) AS BIGINT) AS words FROM part"),
    "ltrim_rtrim": Query("part", '.[] | {k: .p_partkey, cut: (.p_brand | ltrimstr("Brand#")), end: (.p_name | rtrimstr("e"))}',
        "SELECT p_partkey AS k, CASE WHEN starts_with(p_brand, 'Brand#') THEN substr(p_brand, 7) ELSE p_brand END AS cut, CASE WHEN suffix(p_name, 'e') THEN substr(p_name, 1, length(p_name) - 1) ELSE p_name END AS \"end\" FROM part"),
    "interpolation": Query("nation", '.[] | {s: "nation \\(.n_nationkey): \\(.n_name)"}', "SELECT 'nation ' || n_nationkey || ': ' || n_name AS s FROM nation"),
    "regex_test": Query("documents", '.[] | {doc_id, mail: (.text | test("[a-z]+@[a-z]+\\\\.[a-z]+")), year: (.text | test("\\\\b(19|20)[0-9]{2}\\\\b"))}',
        "SELECT doc_id, regexp_matches(text, '[a-z]+@[a-z]+\\.[a-z]+') AS mail, regexp_matches(text, '\\b(19|20)[0-9]{2}\\b') AS year FROM documents"),
    "regex_sub": Query("pages", '.[] | {page_id, plain: (.url | gsub("[0-9]+"; "#")), once: (.url | sub("https?"; "any"))}',
        "SELECT page_id, regexp_replace(url, '[0-9]+', '#', 'g') AS plain, regexp_replace(url, 'https?', 'any') AS once FROM pages"),
    "regex_capture": Query("pages", '.[] | .url | capture("^(?<scheme>[a-z]+)://(?<host>[^/]+)")',
        "SELECT regexp_extract(url, '^([a-z]+)://([^/]+)', 1) AS scheme, regexp_extract(url, '^([a-z]+)://([^/]+)', 2) AS host FROM pages"),
    "regex_scan_words": Query("documents", '[.[] | .text | scan("[0-9]+")] | group_by(length) | map({digits: (.[0] | length), n: length})',
        "SELECT CAST(length(w) AS BIGINT) AS digits, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[0-9]+')) AS w FROM documents) GROUP BY 1"),
    "base64_uri_html": Query("pages", ".[] | {page_id, b: (.url | @base64), u: (.url | @uri), h: (.url | @html)}",
        "SELECT page_id, base64(encode(url)) AS b, url_encode(url) AS u, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&apos;'), '\"', '&quot;') AS h FROM pages"),
    "csv_tsv_rows": Query("nation", ".[] | {c: ([.n_nationkey, .n_name] | @csv), t: ([.n_nationkey, .n_name] | @tsv)}",
        "SELECT n_nationkey || ',\"' || n_name || '\"' AS c, n_nationkey || chr(9) || n_name AS t FROM nation"),
    "math_unary": Query("customer", ".[] | {k: .c_custkey, r: (.c_acctbal | fabs | sqrt | . * 1000 | floor), c: (.c_acctbal | ceil), t: (.c_acctbal | trunc), o: (.c_acctbal | round)}",
        "SELECT c_custkey AS k, floor(sqrt(abs(c_acctbal)) * 1000) AS r, ceil(c_acctbal) AS c, trunc(c_acctbal) AS t, sign(c_acctbal) * floor(abs(c_acctbal) + 0.5) AS o FROM customer"),
    "math_binary": Query("part", ".[] | {k: .p_partkey, p: (pow(.p_size; 2)), h: (hypot(.p_size; .p_size)), m: (fmin(.p_retailprice; 1000))}",
        "SELECT p_partkey AS k, pow(p_size, 2) AS p, round(sqrt(2.0 * p_size * p_size), 4) AS h, least(p_retailprice, 1000.0) AS m FROM part", rounded=("h",)),
    "modulo_trunc": Query("customer", ".[] | {k: .c_custkey, m: (.c_acctbal % 7)}", "SELECT c_custkey AS k, CAST(trunc(c_acctbal) AS BIGINT) % 7 AS m FROM customer"),
    "date_todate_fromdate": Query("orders", '.[] | {o_orderkey, d: (.o_orderdate | fromdate | todate), y: (.o_orderdate | fromdate | strftime("%Y-%m"))}',
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS d, strftime(o_orderdate, '%Y-%m') AS y FROM orders"),
    "date_bucket": Query("orders", '[.[] | {y: (.o_orderdate | fromdate | strftime("%Y")), p: .o_totalprice}] | group_by(.y) | map({y: .[0].y, n: length, p: (map(.p) | add)})',
        "SELECT strftime(o_orderdate, '%Y') AS y, count(*) AS n, round(sum(o_totalprice), 2) AS p FROM orders GROUP BY 1"),
    "json_props_fromjson": Query("events", "[.[] | {k: (.props | fromjson | .k), v: .value}] | group_by(.k) | map({k: .[0].k, n: length})",
        "SELECT CAST(json_extract(props, '$.k') AS DOUBLE) AS k, count(*) AS n FROM events GROUP BY 1"),
    "embedding_length_add": Query("embeddings", ".[] | {vec_id, n: (.embedding | length), s: (.embedding | add)}",
        "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS s FROM embeddings", rounded=("s",)),
    "embedding_map_norm": Query("embeddings", ".[] | {vec_id, norm: (.embedding | map(. * .) | add | sqrt)}",
        "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm FROM embeddings", rounded=("norm",)),
    "embedding_reduce": Query("embeddings", ".[] | {vec_id, s: (reduce .embedding[] as $x (0; . + $x))}",
        "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS s FROM embeddings", rounded=("s",)),
    "contains_inside": Query("documents", '.[] | {doc_id, has: (.text | contains("the ")), in_: ((.lang // "") | inside("en,de"))}',
        "SELECT doc_id, contains(text, 'the ') AS has, contains('en,de', coalesce(lang, '')) AS in_ FROM documents"),
    "unary_minus_abs": Query("customer", ".[] | {k: .c_custkey, neg: (-.c_acctbal), mag: (.c_acctbal | abs)}", "SELECT c_custkey AS k, -c_acctbal AS neg, abs(c_acctbal) AS mag FROM customer"),
    "trim_text": Query("part", '.[] | {k: .p_partkey, t: ("  " + .p_name + " " | trim), l: ("  " + .p_name | ltrim), r: (.p_name + "  " | rtrim)}',
        "SELECT p_partkey AS k, trim(p_name) AS t, ltrim(p_name) AS l, rtrim(p_name) AS r FROM part"),
    "utf8_bytes": Query("documents", ".[] | {doc_id, bytes: (.text | utf8bytelength), chars: (.text | length)}",
        "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, length(text) AS chars FROM documents"),
    "keys_of_rows": Query("region", '.[] | {r: .r_regionkey, ks: (keys | join(",")), n: length}', "SELECT r_regionkey AS r, 'r_name,r_regionkey' AS ks, 2 AS n FROM region"),
    "math_transcendental": Query("part", ".[] | {k: .p_partkey, a: (.p_size | log), b: (.p_size | exp10 | log10), c: (.p_size | sin), d: (.p_size / 100 | atan), e: (.p_size | cbrt)}",
        "SELECT p_partkey AS k, round(ln(p_size), 4) AS a, CAST(p_size AS DOUBLE) AS b, round(sin(p_size), 4) AS c, round(atan(p_size / 100), 4) AS d, round(cbrt(p_size), 4) AS e FROM part", rounded=("a", "b", "c", "d", "e")),
    "array_reverse_unique": Query("embeddings", ".[] | {vec_id, tail: (.embedding | reverse | .[0]), kinds: (.embedding | map(. > 0) | unique | length)}",
        "SELECT vec_id, embedding[-1] AS tail, CAST(len(list_distinct(list_transform(embedding, lambda x: x > 0))) AS BIGINT) AS kinds FROM embeddings"),
    "gmtime_parts": Query("orders", ".[] | (.o_orderdate | fromdate | gmtime) as $t | {o_orderkey, y: $t[0], m: $t[1], w: $t[6], yd: $t[7]}",
        "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) - 1 AS m, dayofweek(o_orderdate) AS w, dayofyear(o_orderdate) - 1 AS yd FROM orders"),
    "group_edges": Query("orders", "group_by(.o_custkey) | map({c: .[0].o_custkey, first: .[0].o_orderkey, last: .[-1].o_orderkey, status: .[0].o_orderstatus})",
        "SELECT o_custkey AS c, min(o_orderkey) AS first, max(o_orderkey) AS last, arg_min(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1", order=_ORD),
    "has_in": Query("embeddings", ".[] | {vec_id, far: (.embedding | has(100)), near: (.embedding | has(3))}",
        "SELECT vec_id, len(embedding) > 100 AS far, len(embedding) > 3 AS near FROM embeddings"),
    "explode_codes": Query("nation", ".[] | {n_name, first: (.n_name | explode | .[0]), total: (.n_name | explode | add)}",
        "SELECT n_name, CAST(unicode(n_name) AS BIGINT) AS first, CAST(list_sum(list_transform(string_split(n_name, ''), lambda c: unicode(c))) AS BIGINT) AS total FROM nation"),
    "assignment_update": Query("customer", '.[] | .c_acctbal |= floor | .c_name = "x" | .c_nationkey += 1 | del(.c_mktsegment)',
        "SELECT c_custkey, 'x' AS c_name, c_nationkey + 1 AS c_nationkey, floor(c_acctbal) AS c_acctbal FROM customer"),
    "with_entries_rename": Query("region", '.[] | with_entries(.key |= ltrimstr("r_"))', "SELECT r_regionkey AS regionkey, r_name AS name FROM region"),
    "pick_fields": Query("supplier", ".[] | pick(.s_suppkey, .s_name)", "SELECT s_suppkey, s_name FROM supplier"),
    "to_entries_unpivot": Query("labels", "[.[] | {quality, toxic}] | [.[] | to_entries[]] | group_by(.key) | map({key: .[0].key, n: length, s: (map(.value) | add)})",
        "SELECT key, count(*) AS n, CAST(sum(value) AS DOUBLE) AS s FROM (SELECT 'quality' AS key, quality AS value FROM labels UNION ALL SELECT 'toxic', toxic FROM labels) GROUP BY 1"),
    "flatten_nested": Query("part", '[.[] | .p_type | split(" ")] | flatten | group_by(.) | map({word: .[0], n: length})',
        "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY 1"),
    "type_selectors": Query("labels", ".[] | {doc_id, a: (.quality | type), b: (.doc_id | type)}",
        "SELECT doc_id, CASE WHEN quality IS NULL THEN 'null' ELSE 'number' END AS a, 'number' AS b FROM labels"),
    "user_function": Query("lineitem", "def net($p; d): $p * (1 - d); .[] | {k: .l_orderkey, n: .l_linenumber, v: net(.l_extendedprice; .l_discount)}",
        "SELECT l_orderkey AS k, l_linenumber AS n, round(l_extendedprice * (1 - l_discount), 4) AS v FROM lineitem", rounded=("v",)),
    "destructure": Query("embeddings", ".[] | .vec_id as $id | .embedding as [$a, $b] | {id: $id, a: $a, b: $b}",
        "SELECT vec_id AS id, embedding[1] AS a, embedding[2] AS b FROM embeddings"),
    "stream_select": Query("events", 'select(.event_type == "click" and .value > 50) | {event_id, value}',
        "SELECT event_id, value FROM events WHERE event_type = 'click' AND value > 50", mode="stream"),
    "not_in_list": Query("orders", '.[] | select(.o_orderstatus | IN("O", "F") | not) | {o_orderkey}', "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('O', 'F')"),
    "array_any_all": Query("embeddings", ".[] | {vec_id, some: (.embedding | any(. > 0.3)), every: (.embedding | all(. < 0.3))}",
        "SELECT vec_id, len(list_filter(embedding, lambda x: x > CAST(0.3 AS DOUBLE))) > 0 AS some, len(list_filter(embedding, lambda x: x < CAST(0.3 AS DOUBLE))) = len(embedding) AS every FROM embeddings"),
    "array_minus": Query("part", '.[] | {k: .p_partkey, rest: ((.p_type | split(" ")) - ["STANDARD", "STEEL"] | join("+"))}',
        "SELECT p_partkey AS k, array_to_string(list_filter(string_split(p_type, ' '), lambda x: x NOT IN ('STANDARD', 'STEEL')), '+') AS rest FROM part"),
    "array_map_select": Query("embeddings", ".[] | {vec_id, n: ([.embedding[] | select(. > 0)] | length), top: (.embedding | map(. * 10 | floor) | max)}",
        "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS n, CAST(list_max(list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 10))) AS DOUBLE) AS top FROM embeddings"),
    "add_strings_join": Query("nation", '[.[] | .n_name] | join(", ") | {names: .}', "SELECT string_agg(n_name, ', ' ORDER BY n_nationkey) AS names FROM nation", order=("n_nationkey",)),
    "range_sequence": Query("region", '.[] | {r: .r_regionkey, k: range(.r_regionkey; 5)}', "SELECT r_regionkey AS r, k FROM region, range(5) t(k) WHERE k >= r_regionkey"),
    "comma_outputs": Query("nation", ".[] | {v: (.n_nationkey, .n_regionkey)}", "SELECT n_nationkey AS v FROM nation UNION ALL SELECT n_regionkey FROM nation"),
    "group_min_by_row": Query("orders", "group_by(.o_custkey) | map({c: .[0].o_custkey, cheapest: (min_by(.o_totalprice) | .o_orderkey), dearest: (max_by(.o_totalprice) | .o_orderkey)})",
        "SELECT o_custkey AS c, arg_min(o_orderkey, o_totalprice) AS cheapest, arg_max(o_orderkey, o_totalprice) AS dearest FROM orders GROUP BY 1", order=_ORD),
    "group_reduce": Query("lineitem", "group_by(.l_shipdate | fromdate | strftime(\"%Y\")) | map({y: (.[0].l_shipdate | fromdate | strftime(\"%Y\")), q: (reduce .[] as $r (0; . + $r.l_quantity))})",
        "SELECT strftime(l_shipdate, '%Y') AS y, sum(l_quantity) AS q FROM lineitem GROUP BY 1"),
    "group_having": Query("orders", "group_by(.o_custkey) | map({c: .[0].o_custkey, n: length}) | map(select(.n > 15))", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15"),
    "three_way_join": Query("nation", "JOIN($regions; .n_regionkey | tostring) | .[] | select(.match.r_name == \"ASIA\") | {n: .row.n_name, r: .match.r_name}",
        "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'", lookups=(("regions", "region", "INDEX(.r_regionkey)"),)),
    # ---- order
    "sort_by_multi": Query("supplier", "sort_by(.s_nationkey, .s_name) | map({s_nationkey, s_name})", "SELECT s_nationkey, s_name FROM supplier", order=("s_suppkey",)),
    "top_k": Query("orders", "sort_by(.o_totalprice) | .[-10:] | map({o_orderkey, o_totalprice})",
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10", order=_ORD),
    "limit_skip": Query("orders", ".[3:8] | map({o_orderkey})",
        "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 3", order=_ORD),
    "first_last": Query("orders", "first(.[] | select(.o_totalprice > 100000)) | {o_orderkey}",
        "SELECT min(o_orderkey) AS o_orderkey FROM orders WHERE o_totalprice > 100000", order=_ORD),
    "unique_by_key": Query("orders", "unique_by(.o_orderpriority) | map({o_orderpriority, o_orderkey})",
        "SELECT o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1", order=_ORD),
    "unique_values": Query("part", "map(.p_brand) | unique | .[] | {brand: .}", "SELECT DISTINCT p_brand AS brand FROM part"),
    "min_by_row": Query("part", "min_by(.p_retailprice) | {p_partkey, p_retailprice}", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 1", order=("p_partkey",)),
    "max_by_row": Query("part", "max_by(.p_retailprice) | {p_partkey, p_retailprice}", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 1", order=("p_partkey",)),
    "whole_array": Query("lineitem", "{n: length, qty: (map(.l_quantity) | add), late: any(.l_quantity > 49), pos: all(.l_quantity > 0)}",
        "SELECT count(*) AS n, sum(l_quantity) AS qty, bool_or(l_quantity > 49) AS late, bool_and(l_quantity > 0) AS pos FROM lineitem"),
    "reduce_sum": Query("orders", "reduce .[] as $o (0; . + $o.o_totalprice) | {total: .}", "SELECT round(sum(o_totalprice), 2) AS total FROM orders"),
    "running_total_foreach": Query("region", "foreach .[] as $r (0; . + $r.r_regionkey; {k: $r.r_regionkey, upto: .})",
        "SELECT r_regionkey AS k, CAST(sum(r_regionkey) OVER (ORDER BY r_regionkey) AS BIGINT) AS upto FROM region", order=("r_regionkey",)),
    "running_total_customers": Query("customer", "foreach .[] as $c (0; . + $c.c_nationkey; {k: $c.c_custkey, upto: .})",
        "SELECT c_custkey AS k, CAST(sum(c_nationkey) OVER (ORDER BY c_custkey) AS BIGINT) AS upto FROM customer", order=("c_custkey",)),
    "rank_rows": Query("orders", "sort_by(.o_totalprice) | to_entries | map({rank: .key, k: .value.o_orderkey})",
        "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rank, o_orderkey AS k FROM orders", order=_ORD),
    "slice_from": Query("orders", ".[100:] | map({o_orderkey})", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100", order=_ORD),
    "slice_between": Query("orders", "sort_by(-.o_totalprice) | .[100:-200] | map({o_orderkey})",
        "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r > 100 AND r <= n - 200", order=_ORD),
    "slice_from_end": Query("orders", ".[-8:-3] | map({o_orderkey})", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 5 OFFSET 3)", order=_ORD),
    "array_slice_sort": Query("embeddings", ".[] | {vec_id, low: (.embedding | min), high: (.embedding | max), mid: (.embedding | sort | .[32])}",
        "SELECT vec_id, list_min(embedding) AS low, list_max(embedding) AS high, list_sort(embedding)[33] AS mid FROM embeddings"),
    "range_generators": Query("region", ".[] | {r: .r_regionkey, k: range(3)}", "SELECT r_regionkey AS r, k FROM region, range(3) t(k)"),
    # ---- joins
    "index_join_lookup": Query("customer", "JOIN($nations; .c_nationkey | tostring) | .[] | {k: .row.c_custkey, nation: .match.n_name}",
        "SELECT c_custkey AS k, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey", lookups=(("nations", "nation", "INDEX(.n_nationkey)"),)),
    "join_left_missing": Query("documents", "JOIN($labels; .doc_id | tostring) | .[] | {doc_id: .row.doc_id, q: (.match.quality // -1)}",
        "SELECT d.doc_id, coalesce(l.quality, -1) AS q FROM documents d LEFT JOIN (SELECT doc_id, arg_max(quality, rowid_) AS quality FROM (SELECT *, row_number() OVER () AS rowid_ FROM labels) GROUP BY 1) l USING (doc_id)", lookups=(("labels", "labels", "INDEX(.doc_id)"),)),
    "in_list": Query("orders", ".[] | select(.o_orderpriority | IN(\"1-URGENT\", \"2-HIGH\")) | {o_orderkey}", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "in_semi": Query("customer", ".[] | select(.c_custkey | IN($orders[].o_custkey)) | {c_custkey}", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", lookups=_ORDERS),
    "not_in_anti": Query("customer", ".[] | select(.c_custkey | IN($orders[].o_custkey) | not) | {c_custkey}",
        "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", lookups=_ORDERS),
    "any_semi_correlated": Query("customer", ".[] as $c | $c | select(any($orders[]; .o_custkey == $c.c_custkey and .o_totalprice > $c.c_acctbal * 30)) | {c_custkey, c_name}",
        "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 30)", lookups=_ORDERS),
    "all_anti_correlated": Query("nation", ".[] as $n | $n | select(all($suppliers[]; .s_nationkey != $n.n_nationkey or .s_acctbal > 0)) | {n_name}",
        "SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal <= 0)", lookups=(("suppliers", "supplier", "."),)),
    "semi_of_selected": Query("part", ".[] | select(IN(.p_brand; $brands[].b)) | {p_partkey}",
        "SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size > 48)", lookups=(("brands", "part", ".[] | select(.p_size > 48) | {b: .p_brand}"),)),
    "cross_theta_join": Query("nation", ".[] as $n | $regions[] as $r | select($n.n_regionkey < $r.r_regionkey) | {n: $n.n_name, r: $r.r_name}",
        "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey < r_regionkey", lookups=(("regions", "region", "."),)),
    "cross_equi_join": Query("nation", ".[] as $n | $regions[] as $r | select($n.n_regionkey == $r.r_regionkey) | {n: $n.n_name, r: $r.r_name}",
        "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey", lookups=(("regions", "region", "."),)),
    "join_then_group": Query("customer", '[JOIN($nations; .c_nationkey | tostring) | .[] | {nation: .match.n_name, bal: .row.c_acctbal}] | group_by(.nation) | map({nation: .[0].nation, n: length, bal: (map(.bal) | add)})',
        "SELECT n_name AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", lookups=(("nations", "nation", "INDEX(.n_nationkey)"),)),
}

#: Sums that are rounded to cents on both sides.
_CENTS = {"group_multi_key": ["disc"], "date_bucket": ["p"], "reduce_sum": ["total"], "join_then_group": ["bal"]}


def _run(name: str, q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = q.run(spark, sf_dir)
        return out.withColumns({c: F.round(F.col(c), 2) for c in _CENTS.get(name, [])}) if name in _CENTS else out

    return run


def evaluator_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-document evaluator over JSON text: dynamic keys, try, recursion and label have no typed plan."""
    program = 'def depth: if type == "object" then 1 + ([.[] | depth] | max // 0) else 0 end; {n: (to_entries | length), d: depth, k: (try (.k | tonumber) catch -1)} | tojson | fromjson | .k'
    out = jq_documents(spark.read.parquet(f"{sf_dir}/events.parquet"), "props", program, keep=["event_id"], spread=spark.sparkContext.defaultParallelism)
    return out.select("event_id", F.col("value").cast("double").alias("k"))


def yq_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update of JSON text by the YAML expression language."""
    out = yq_documents(spark.read.parquet(f"{sf_dir}/events.parquet"), "props", ".k += 1 | .k", "json", "json", keep=["event_id"], spread=spark.sparkContext.defaultParallelism)
    return out.select("event_id", F.col("value").cast("double").alias("k"))


def yq_sub_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sub replaces every match."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.to_json(F.struct("url")).alias("doc"))
    out = yq_documents(pages, "doc", '.url |= sub("[0-9]+", "#") | .url', "json", "yaml", keep=["page_id"])
    return out.select("page_id", F.regexp_replace("value", "\n$", "").alias("url"))


def yq_pick_omit(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("doc"))
    out = yq_documents(nations, "doc", 'pick(["n_regionkey", "n_name"]) | omit(["n_name"]) | to_entries | .[0].value', "json", "json", keep=["n_nationkey"])
    return out.select("n_nationkey", F.col("value").cast("long").alias("v"))


def yq_glob_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.to_json(F.struct("n_name")).alias("doc"))
    out = yq_documents(nations, "doc", 'select(.n_name == "*A*") | .n_name', "json", "yaml")
    return out.filter("value <> ''").select(F.trim(F.regexp_replace("value", "\n", "")).alias("name"))


def dynamic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of any type grouped by value, by way of their sort keys."""
    keyed = sort_keys(spark.read.parquet(f"{sf_dir}/events.parquet").select("props"), "props")
    return keyed.groupBy("sort_key").agg(F.min("props").alias("props"), F.count("*").alias("n")).select("props", "n")


def stream_events_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming form of each document, counted by path."""
    found = events(spark.read.parquet(f"{sf_dir}/events.parquet"), "props", keep=["event_id"])
    return found.groupBy("path").agg(F.count("leaf").alias("leaves"), F.count("*").alias("n"))


_EVALUATED = {
    "evaluator_events": (evaluator_events, "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events"),
    "yq_numbers": (yq_numbers, "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) + 1 AS k FROM events"),
    "yq_sub_global": (yq_sub_global, "SELECT page_id, regexp_replace(url, '[0-9]+', '#', 'g') AS url FROM pages"),
    "yq_pick_omit": (yq_pick_omit, "SELECT n_nationkey, CAST(n_regionkey AS BIGINT) AS v FROM nation"),
    "yq_glob_equals": (yq_glob_equals, "SELECT n_name AS name FROM nation WHERE n_name LIKE '%A%'"),
    "dynamic_groups": (dynamic_groups, "SELECT props, count(*) AS n FROM events GROUP BY 1"),
    "stream_events_count": (stream_events_count, "SELECT '[\"k\"]' AS path, count(*) AS leaves, 2 * count(*) AS n FROM events"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{name: _run(name, q) for name, q in QUERIES.items()}, **{name: f for name, (f, _) in _EVALUATED.items()}, **document_queries.queries()}


def oracle_sql() -> dict[str, str]:
    return {**{name: q.sql for name, q in QUERIES.items() if q.sql}, **{name: sql for name, (_, sql) in _EVALUATED.items()}, **document_queries.oracle_sql()}
