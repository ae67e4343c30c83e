from __future__ import annotations

import io

import pytest

from sylva.cli import jq_main, yq_main


def call(main, args, text=""):
    out, err = io.StringIO(), io.StringIO()
    status = main(args, io.StringIO(text), out, err)
    return out.getvalue(), status, err.getvalue()


@pytest.mark.parametrize(("args", "text", "out", "status"), [
    ([".a"], '{"a":1} {"a":2}', "1\n2\n", 0),
    (["-c", "."], '{"b":[1,2]}', '{"b":[1,2]}\n', 0),
    (["-s", "-c", "."], "1 2", "[1,2]\n", 0),
    (["-R", "."], "x\ny\n", '"x"\n"y"\n', 0),
    (["-Rs", "."], "x\ny\n", '"x\\ny\\n"\n', 0),
    (["-n", "[inputs]", "-c"], "1 2", "[1,2]\n", 0),
    (["-r", ".[]"], '["a",1]', "a\n1\n", 0),
    (["-j", ".[]"], '["a",1]', "a1", 0),
    (["--raw-output0", ".[]"], '["a","b"]', "a\0b\0", 0),
    (["-a", "."], '"é"', '"\\u00e9"\n', 0),
    (["-S", "-c", "."], '{"b":1,"a":2}', '{"a":2,"b":1}\n', 0),
    (["--tab", "."], "[1]", "[\n\t1\n]\n", 0),
    (["--indent", "1", "."], "[1]", "[\n 1\n]\n", 0),
    (["--arg", "x", "1", "--argjson", "y", "2", "-n", "-c", "[$x, $y, $ARGS.named.x]"], "", '["1",2,"1"]\n', 0),
    (["-n", "-c", "$ARGS.positional", "--args", "a", "b"], "", '["a","b"]\n', 0),
    (["--stream", "-c", "."], '{"a":[1]}', '[["a",0],1]\n[["a",0]]\n[["a"]]\n', 0),
    (["--seq", "."], "1", "\x1e1\n", 0),
    (["-e", "."], "null", "null\n", 1),
    (["-e", "empty"], "1", "", 4),
    (["."], "{", "", 2),
    ([".a["], "1", "", 3),
    (["error"], "1", "", 5),
    (["-n", '"x" | halt_error(7)'], "", "", 7),
    (["--nope"], "", "", 2),
    (["-c", "[., input_line_number]"], '1\n{"a":\n"]"}\n3', '[1,1]\n[{"a":"]"},3]\n[3,3]\n', 0),
    (["-R", "."], "a\u2028b\n", '"a\u2028b"\n', 0),
    (["-c", "."], '"\\"[\\\\"\n[1\n,2]\n', '"\\"[\\\\"\n[1,2]\n', 0),
])
def test_jq(args, text, out, status):
    assert call(jq_main, args, text)[:2] == (out, status)


def test_jq_answers_before_its_input_ends():
    out = io.StringIO()

    def lines():
        yield '{"a":\n'
        assert out.getvalue() == ""
        yield '1}\n'
        assert out.getvalue() == "1\n"
        yield "2\n"
        assert out.getvalue() == "1\n2\n"

    assert jq_main([".a? // ."], lines(), out, io.StringIO()) == 0 and out.getvalue() == "1\n2\n"


def test_jq_files_and_colours(tmp_path):
    (tmp_path / "a.json").write_text("[1]")
    (tmp_path / "m.jq").write_text("def f: 5;")
    assert call(jq_main, ["-c", "input_filename", str(tmp_path / "a.json")])[0] == f'"{tmp_path}/a.json"\n'
    assert call(jq_main, ["-L", str(tmp_path), "-n", 'import "m" as m; m::f'])[0] == "5\n"
    assert call(jq_main, ["--slurpfile", "x", str(tmp_path / "a.json"), "-n", "-c", "$x"])[0] == "[[1]]\n"
    assert "\x1b[" in call(jq_main, ["-C", "."], '{"a":[null,true]}')[0]
    assert call(jq_main, ["debug, stderr"], "1")[2] == '["DEBUG:",1]\n1'


@pytest.mark.parametrize(("args", "text", "out"), [
    ([".a"], "a: 1\n", "1\n"),
    (["-o", "json", "-I0", "."], "a: [1]\n", '{"a":[1]}\n'),
    (["-p", "json", "-o=yaml", "."], '{"a":1}', "a: 1\n"),
    (["-n", ".a = 1"], "", "a: 1\n"),
    (["-N", "."], "a: 1\n---\nb: 2\n", "a: 1\nb: 2\n"),
    (["-0", ".[]"], "[a, b]\n", "a\0b\0"),
    (["-P", "."], "{a: [1]}\n", "a:\n  - 1\n"),
    (["ea", "[.[]] | length"], "a: 1\n---\nb: 2\n", "2\n"),
    (["--front-matter=process", ".a = 2"], "---\na: 1\n---\nbody\n", "a: 2\n---\nbody\n"),
    (["--front-matter=extract", ".a"], "---\na: 1\n---\nbody\n", "1\n"),
    (["-N", ".a"], "a: |\n  x\n  ---\n  y\n---\na: z\n", "x\n---\ny\n\nz\n"),
    (["-nP", ".a.b = 1"], "", "a:\n  b: 1\n"),
    (["-p", "csv", "--csv-separator", ";", "-o=json", "-I0", "."], "a;b\n1;x\n", '[{"a":1,"b":"x"}]\n'),
    (["-p", "csv", "--csv-auto-parse=false", "-o=json", "-I0", "."], "a\n1\n", '[{"a":"1"}]\n'),
    (["-p", "tsv", "--tsv-auto-parse=false", "-o=json", "-I0", "."], "a\n1\n", '[{"a":"1"}]\n'),
    (["-o", "csv", "--csv-separator=;", "."], "- [1, 2]\n", "1;2\n"),
    (["-p", "xml", "--xml-attribute-prefix", "_", "--xml-content-name", "t", "-o=json", "-I0", "."], '<a k="1">x</a>', '{"a":{"t":"x","_k":"1"}}\n'),
    (["-p", "xml", "--xml-skip-proc-inst", "--xml-skip-directives", "-o=json", "-I0", "."], '<?xml version="1.0"?><!DOCTYPE a><a>1</a>', '{"a":"1"}\n'),
    (["-p", "xml", "--xml-keep-namespace=false", "-o=json", "-I0", "."], '<x:a xmlns:x="u"><x:b>1</x:b></x:a>', '{"a":{"+@x":"u","b":"1"}}\n'),
    (["-p", "xml", "--xml-raw-token=false", "-o=json", "-I0", "."], '<x:a xmlns:x="u"><x:b>1</x:b></x:a>', '{"u:a":{"+@xmlns:x":"u","u:b":"1"}}\n'),
    (["-o", "xml", "--xml-attribute-prefix", "_", "."], "a: {_k: 1, b: 2}\n", '<a k="1">\n  <b>2</b>\n</a>\n'),
    (["-o", "props", "--properties-separator", ":", "--properties-array-brackets", "."], "a: [1, {b: 2}]\n", "a[0]:1\na[1].b:2\n"),
    (["-o", "lua", "--lua-prefix", "x = ", "--lua-suffix", "\n", "--lua-unquoted", "."], "a: 1\nend: 2\n", 'x = {\n\ta = 1;\n\t["end"] = 2;\n}\n'),
    (["-o", "lua", "--lua-globals", "."], "a: 1\nb: [2]\n", "a = 1;\nb = {\n\t2,\n};\n"),
    (["-o", "shell", "--shell-key-separator", "__", "."], "a: {b: 1}\n", "a__b=1\n"),
    (["--string-interpolation=false", '.a = "\\(1)"'], "a: x\n", "a: \\(1)\n"),
    (["-o=json", "-I0", ".d"], "b: &b {x: 1}\nd: {x: 0, <<: *b}\n", '{"x":1}\n'),
    (["--yaml-fix-merge-anchor-to-spec", "-o=json", "-I0", ".d"], "b: &b {x: 1}\nd: {x: 0, <<: *b}\n", '{"x":0}\n'),
    ([".d.x"], "b: &b {x: 1}\nc: &c {x: 2}\nd: {<<: [*b, *c]}\n", "2\n"),
    (["--yaml-fix-merge-anchor-to-spec", ".d.x"], "b: &b {x: 1}\nc: &c {x: 2}\nd: {<<: [*b, *c]}\n", "1\n"),
])
def test_yq(args, text, out):
    assert call(yq_main, args, text)[:2] == (out, 0)


def test_yq_files(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.yml").write_text("a: 1 # c\n")
    (tmp_path / "b.json").write_text('{"b":2}')
    assert call(yq_main, ["-i", ".a = 2", "a.yml"])[1] == 0 and (tmp_path / "a.yml").read_text() == "a: 2 # c\n"
    assert call(yq_main, ["ea", "select(fi == 0) * {\"b\": 1}", "a.yml"])[0] == "a: 2 # c\nb: 1\n"
    assert call(yq_main, [".a = load(\"b.json\").b", "a.yml"])[0] == "a: 2 # c\n"
    assert call(yq_main, ["-s", "\"f\" + $index", ".[]", "a.yml"])[1] == 0 and (tmp_path / "f0.yml").read_text().startswith("2")
    assert call(yq_main, [".a[", "a.yml"])[1] == 1 and call(yq_main, ["-e", ".zz", "a.yml"])[1] == 1


def test_yq_flags(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "e.yq").write_text(".a")
    (tmp_path / "s.yq").write_text('"out/" + .')
    assert call(yq_main, ["--from-file", "e.yq"], "a: 5\n")[0] == "5\n"
    assert call(yq_main, ["--split-exp-file", "s.yq", ".[]"], "[p, q]\n")[1] == 0 and (tmp_path / "out" / "q.yml").read_text() == "q\n"
    assert call(yq_main, ["--nope", "."], "a: 1\n")[1] == 1 and "unknown flag" in call(yq_main, ["--nope", "."])[2]
    assert call(yq_main, ["--security-disable-env-ops", "-n", "env(HOME)"])[1] == 1
    assert call(yq_main, ["--security-disable-file-ops", "-n", 'load("e.yq")'])[1] == 1
