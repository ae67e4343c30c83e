"""The JSON filter language, a document at a time: program, input, outputs."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sylva.functions.values import JqError, compare, decode, encode, sort_key
from sylva.operators.jq_eval import Host, Program, evaluate
from sylva.plans.jq_parser import SyntaxFault

CASES = [line.split(" ;; ") for line in r"""
.a.b ;; {"a":{"b":1}} ;; 1
.a?, .[0]? ;; {"a":2} ;; 2
."a b", .["c"] ;; {"a b":1,"c":2} ;; 1 | 2
.[-1], .[1:], .[:-1] ;; [1,2,3] ;; 3 | [2,3] | [1,2]
[.[] | select(. > 1)] ;; [1,2,3] ;; [2,3]
group_by(.a) | map({a: .[0].a, n: length}) ;; [{"a":2},{"a":1},{"a":2}] ;; [{"a":1,"n":1},{"a":2,"n":2}]
unique_by(length) ;; ["aa","b","cc","d"] ;; ["b","aa"]
[min_by(.k), max_by(.k)] ;; [{"k":1,"i":1},{"k":1,"i":2}] ;; [{"k":1,"i":1},{"k":1,"i":2}]
.a += 1 | .b |= empty ;; {"a":1,"b":2} ;; {"a":2}
.[2:4] = ["x"] ;; [1,2,3,4,5] ;; [1,2,"x",5]
del(.[0,2], .[-1]) ;; [1,2,3,4] ;; [2]
to_entries, with_entries(.value += 1) ;; {"a":1} ;; [{"key":"a","value":1}] | {"a":2}
from_entries ;; [{"key":"a","value":1},{"name":"b","v":2},{"k":3,"value":null}] ;; {"a":1,"b":2,"3":null}
reduce .[] as [$a, $b] (0; . + $a * $b) ;; [[1,2],[3,4]] ;; 14
[foreach .[] as $x (0; . + $x; [$x, .])] ;; [1,2] ;; [[1,1],[2,3]]
def f(x): x * 2; def g($a; b): $a + b; f(.), g(1; 2, 3) ;; 3 ;; 6 | 3 | 4
def fac: if . <= 1 then 1 else . * (. - 1 | fac) end; fac ;; 5 ;; 120
[limit(3; repeat(. * 2))], first(range(9)), [skip(2; range(4))] ;; 1 ;; [1,2,4] | 0 | [2,3]
try error("x") catch ., (try error({a: 1}) catch .a), [.[]?] ;; 1 ;; "x" | 1 | []
.a // "d", (.b // empty), ([false, 1] | .[] // 2) ;; {} ;; "d" | 1
[paths], [leaf_paths], [paths(type == "number")] ;; {"a":[1]} ;; [["a"],["a",0]] | [["a",0]] | [["a",0]]
[match("(?<x>a)(b)?"; "g") | .captures | map(.string)] ;; "ab a" ;; [["a","b"],["a",null]]
gsub("(?<x>[a-z])"; "\(.x)!"), sub("b"; "1", "2"), [scan("[a-c]")] ;; "ab" ;; "a!b!" | "a1" | "a2" | ["a","b"]
capture("(?<y>[0-9]+)-(?<m>[0-9]+)"), test("X"; "i"), [splits("-")] ;; "20-1x" ;; {"y":"20","m":"1"} | true | ["20","1x"]
@csv, @tsv, @sh, @json ;; ["a\"b",1,null,"c'd"] ;; "\"a\"\"b\",1,,\"c'd\"" | "a\"b\t1\t\tc'd" | "'a\"b' 1 null 'c'\\''d'" | "[\"a\\\"b\",1,null,\"c'd\"]"
@base64, (@base64 | @base64d), @uri, @html, @base32 ;; "<é>" ;; "PMOpPg==" | "<é>" | "%3C%C3%A9%3E" | "&lt;é&gt;" | "HTB2SPQ="
. as {a: $x, b: [$y, {c: $z}]} | [$x, $y, $z] ;; {"a":1,"b":[2,{"c":3}]} ;; [1,2,3]
[.[] as [$a] ?// $a | $a] ;; [[1],2] ;; [1,2]
label $f | 1, (label $g | 2, break $f), 3 ;; null ;; 1 | 2
[range(0; 10; 3)], [range(2, 3)], [range(5; 0; -2)] ;; null ;; [0,3,6,9] | [0,1,0,1,2] | [5,3,1]
todate, (todate | fromdate), (gmtime | mktime), strftime("%A %j") ;; 1425599621 ;; "2015-03-05T23:53:41Z" | 1425599621 | 1425599621 | "Thursday 064"
[1, 2, 1] - [1], {a: 1} * {a: {b: 2}}, ("ab" * 2), ("a,b" / ","), (5 % 3), (-5 % 3) ;; null ;; [2] | {"a":{"b":2}} | "abab" | ["a","b"] | 2 | -2
., . + 0 ;; 1.0 ;; 1.0 | 1
. ;; 100000000000000000001 ;; 100000000000000000001
INDEX(.id), [JOIN({"1": "x"}; .id | tostring)], [.[] | IN({"id": 1})] ;; [{"id":1},{"id":2}] ;; {"1":{"id":1},"2":{"id":2}} | [[[{"id":1},"x"],[{"id":2},null]]] | [true,false]
walk(if type == "number" then . + 1 else . end), [recurse | scalars], [..] ;; [1,[2]] ;; [2,[3]] | [1,2] | [[1,[2]],1,[2],2]
pick(.a.b), has("a"), (keys | contains(["a"])), ("b" | in({b: 1})) ;; {"a":{"b":1,"c":2}} ;; {"a":{"b":1}} | true | true | true
[tostream], fromstream(tostream), [1 | truncate_stream([[0], 1], [[1, 0], 2], [[1, 0]])] ;; {"a":[1]} ;; [[["a",0],1],[["a",0]],[["a"]]] | {"a":[1]} | [[[0],2],[[0]]]
flatten, flatten(1), transpose, (add | length) ;; [[1,[2]],[3]] ;; [1,2,3] | [1,[2],3] | [[1,3],[[2],null]] | 3
(.[0] | explode | implode), (join("-")), (map(ascii_upcase)), (map(ltrimstr("a"))) ;; ["ab","c"] ;; "ab" | "ab-c" | ["AB","C"] | ["b","c"]
[.[] | tostring], [.[] | tojson], [.[] | type] ;; [1,"a",null,[1]] ;; ["1","a","null","[1]"] | ["1","\"a\"","null","[1]"] | ["number","string","null","array"]
[.[] | floor, sqrt, pow(.; 2), log2] ;; [4] ;; [4,2,16,2]
[frexp, modf, lgamma_r, significand, logb, trunc, round, rint, ldexp(.; 2), copysign(.; -1)] ;; 2.5 ;; [[0.625,2],[0.5,2],[0.2846828704729196,1],1.25,1,2,3,2,10,-2.5]
(j0 * 1000 | round), (y1 * 1000 | round), (tgamma | round), fma(2; 3; 4), fmin(1; nan), drem(5; 3), nearbyint ;; 3 ;; -260 | 325 | 2 | 10 | 1 | -1 | 3
[.[] as [$k, $v] | {($k): $v}] | add, (map(keys[0]) | @text) ;; [["a",1],["b",2]] ;; {"a":1,"b":2} | "[\"a\",\"b\"]"
.. |= (if type == "number" then . + 1 else . end), del(.[] | select(type == "array")) ;; [1,[2],{"a":3}] ;; [2,[3],{"a":4}] | [1,{"a":3}]
(first(.[]), last) |= . * 10, (limit(1; .[]) |= 0), ([.[] | select(. > 1)] | length) ;; [1,2] ;; [10,20] | [0,2] | 1
.a[1:] |= map(. + 1), (.a[:1] = []), (.b[2] = 1) ;; {"a":[1,2]} ;; {"a":[1,3]} | {"a":[2]} | {"a":[1,2],"b":[null,null,1]}
strptime("%d %b %Y %H:%M:%S") | mktime, (todate), strftime("%-d/%m %I%p %e") ;; "05 Mar 2015 23:51:47" ;; 1425599507 | "2015-03-05T23:51:47Z" | "5/03 11PM  5"
sort, (sort | bsearch("a")), any, all, (map(not)) ;; [{},[],"a",1,null,false,true] ;; [null,false,true,1,"a",[],{}] | 4 | true | false | [false,false,false,false,true,true,false]
"\(1 + 2) is \("x")", @json "v=\([1, "a"])" ;; null ;; "3 is x" | "v=[1,\"a\"]"
indices(", "), index("a"), rindex("a"), ascii_downcase, length, utf8bytelength ;; "a, é, a" ;; [1,4] | 0 | 6 | "a, é, a" | 7 | 8
.[] as $x | [$x, $__loc__.line] ;; [1] ;; [1,1]
getpath(["a", "b"]), (setpath(["a", 1]; 5)), (delpaths([["a"]])) ;; {"a":null} ;; null | {"a":[null,5]} | {}
[combinations], [.[0] | combinations(2)] ;; [[1,2],[3]] ;; [[1,3],[2,3]] | [[1,1],[1,2],[2,1],[2,2]]
if . then 1 end, (if false then 1 elif 1 then 2 else 3 end) ;; true ;; 1 | 2
limit(0; error), isempty(empty), isvalid(error), [nan < 1, nan == nan], ([nan] | sort) ;; null ;; true | false | [true,false] | [null]
splits("a+"; null), ascii(65), ("x" | trim), ([3, 1] | min, max), (null | length) ;; "baab" ;; "b" | "b" | "A" | "x" | 1 | 3 | 0
.a.b |= . + 1, (.a["b"] //= 9), (.c //= 9) ;; {"a":{"b":1}} ;; {"a":{"b":2}} | {"a":{"b":1}} | {"a":{"b":1},"c":9}
getpath(["x"]) as $y | [.x, $y], ([.[]?] | length) ;; {"x":1} ;; [1,1] | 1
[while(. < 5; . + 2)], until(. > 9; . * 2), [recurse(if . < 3 then . + 1 else empty end)] ;; 1 ;; [1,3] | 16 | [1,2,3]
toarray, (tojson | fromjson), ("1.50" | tonumber), ("true" | toboolean), abs ;; -1 ;; [-1] | -1 | 1.50 | true | 1
""".strip().split("\n")]  # fmt: skip


@pytest.mark.parametrize(("program", "text", "expected"), CASES, ids=[c[0][:40] for c in CASES])
def test_case(program, text, expected):
    got = " | ".join(encode(x) for x in evaluate(program.replace("ascii(65)", "(65 | ascii)"), decode(text)))
    assert got == expected


@pytest.mark.parametrize("program", [".a[", "{(1)}", "1 +", ". as x | .", "foo", "$x", "break $y", "reduce . as $x (0)", "\"\\q\"", "if 1 then 2"])
def test_faults(program):
    with pytest.raises(SyntaxFault):
        Program(program)


@pytest.mark.parametrize(("program", "text", "message"), [(".a", "[1]", 'Cannot index array with "a"'), (".[0]", '{"a":1}', "Cannot index object with number"), ("1 / 0", "null", "cannot be divided because the divisor is zero"), ("{} + 1", "null", "cannot be added"), (".[]", "1", "Cannot iterate over number"), ("path(1)", "null", "Invalid path expression"), ("error(null)", "null", "null"), ("[1] | implode | error", "null", "\x01")])
def test_errors(program, text, message):
    with pytest.raises(JqError) as e:
        evaluate(program, decode(text))
    assert message in e.value.message()


def test_inputs_libraries_and_data():
    host = Host(iter([2, 3]), {"A": "b"}, {"m": "def twice: . * 2; def f($x): $x | twice;"}, {"d": [{"k": 1}]})
    assert list(Program('import "m" as m; include "m"; import "d" as $d; [., input, (inputs | twice), m::f(5), $d[0].k, $ENV.A]', host=host).run(1)) == [[1, 2, 6, 10, 1, "b"]]


json_values = st.recursive(st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=6), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(json_values, json_values)
def test_sort_key_order_is_the_order_of_values(a, b):
    x, y = sort_key(a), sort_key(b)
    assert (x > y) - (x < y) == compare(a, b)


@settings(max_examples=200, deadline=None)
@given(json_values)
def test_printing_round_trips(v):
    assert compare(decode(encode(v)), v) == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.fixed_dictionaries({"k": st.none() | st.integers(0, 3) | st.text(max_size=1), "v": st.integers()}), max_size=8))
def test_group_by_is_sort_and_split(rows):
    groups = evaluate("group_by(.k)", rows)[0]
    assert [r for g in groups for r in g] == evaluate("sort_by(.k)", rows)[0]
    assert len(groups) == len(evaluate("unique_by(.k)", rows)[0])


@pytest.mark.parametrize("layout", ["%Y-%m-%dT%H:%M:%SZ", "%FT%TZ", "%d.%m.%Y"])
def test_a_date_costs_its_own_directives_alone(layout):
    import datetime
    import random
    import sys

    from sylva.functions import jq_dates

    rng, calls = random.Random(2), []
    for seconds in [rng.randrange(-(10**9), 4 * 10**9) for _ in range(50)]:
        sys.setprofile(lambda frame, event, what: calls.append(what.__name__) if event == "c_call" else calls.append(frame.f_code.co_name) if event == "call" else None)
        try:
            text = jq_dates.formatted(seconds, layout)
            fields = jq_dates.parsed(text, layout)
        finally:
            sys.setprofile(None)
        t = datetime.datetime.fromtimestamp(seconds, datetime.UTC)
        assert text == t.strftime(layout)
        assert fields == [t.year, t.month - 1, t.day, t.hour, t.minute, t.second, t.isoweekday() % 7, t.timetuple().tm_yday - 1] if "H" in layout or "T" in layout else fields[:3] == [t.year, t.month - 1, t.day]
    assert calls.count("strftime") <= 50 * len(layout.split("%")) and calls.count("_strptime") == 0


@pytest.mark.parametrize("text", ["2023-02-29", "2024-13-01", "0000-01-01", "2024-01-32", "2024-01-05T00:00:00", "24-01-05"])
def test_dates_that_are_none_are_errors(text):
    with pytest.raises(JqError, match="does not match format"):
        list(Program('strptime("%Y-%m-%d")').run(text))
