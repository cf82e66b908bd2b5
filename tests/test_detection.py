"""Names, signs, rules, decoded layers and taint passes."""

import base64
import hashlib
import io
import json
import random
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from vigilspark.functions import classify
from vigilspark.operators import folding, layers, rules
from vigilspark.operators.taint import archive, asp, classcode, classfile, php, scripts, ssi


def test_names(spark):
    names = {
        "/a/x.php": "php", "/a/x.PHP.bak": "php", "/a/x.class.php": "php", "/a/x.config.json": "unknown", "/a/x.txt": "unknown", "/a/x": "unknown", "/a/.htaccess": "unknown", "/a/.php": "unknown",
        "/a/x.jsp.txt": "jsp", "/a/x.war": "jvm-artifact", "/a/x.war.txt": "unknown", "/a/x.config": "config", "/a/x.php.jpg": "php", "/a/...x.asp": "asp", "/a/x.html": "static",
    }
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r.path: r.lang for r in df.select("path", classify.language(F.col("path")).alias("lang")).collect()}
    assert got == names
    assert all(scripts.language_name(n) == lang for n, lang in names.items())


def test_bounded_text(spark):
    df = spark.createDataFrame([("aé\tb" * 3,)], "s string")
    r = df.select(classify.printable(F.col("s")).alias("a"), classify.printable(F.col("s"), 6).alias("b"), classify.printable(F.col("s"), 2).alias("c")).first()
    assert (r.a, r.b, r.c) == ("aé?baé?baé?b", "aé?ba", "a")


def test_binary_needs_a_strong_marker(spark):
    df = spark.createDataFrame([("\x00<? x",), ("\x00<?php x",), ("<? x",), ("x" * 8000 + "\x00<? x",)], "text string")
    got = [list(r.s) for r in df.select(classify.signs(F.col("text"), classify.looks_binary(F.col("text"))).alias("s")).collect()]
    assert got == [[], ["php"], ["php"], ["php"]]


RULES = """
private rule base { strings: $a = "alpha" condition: $a }
rule word { strings: $a = "cat" fullword nocase condition: $a }
rule wide_text { strings: $a = "ab" wide condition: $a }
rule hex { strings: $a = { 61 ?? 63 } condition: any of them }
rule twice { strings: $a = /x+/ condition: #a == 3 }
rule refers { strings: $b = "beta" condition: base and not any of them }
rule placed { strings: $a = "zz" condition: $a at 3 or $a in (5..7) }
rule number { condition: uint16(0) == 0x5A4D }
rule php { meta: lang = "php" strings: $a = "q" condition: $a }
"""


def test_rule_algebra(spark):
    found = rules.rule_set(RULES)
    texts = {"a Cat.": {"word"}, "concat": set(), "xa\x00b\x00": {"wide_text"}, "1abc2": {"hex"}, "xx-x": {"twice"}, "alpha": {"refers"}, "alpha beta": set(), "012zz": {"placed"}, "01234567zz": set(), "0123456zz": {"placed"}, "MZ..": {"number"}, "q": set()}
    df = spark.createDataFrame([(f"/{i}.txt", t) for i, t in enumerate(texts)] + [("/q.php", "q"), ("/q.bin", "<?php q"), ("/q.jsp", "<?php q"), ("/null.php", None)], "path string, text string")
    got, how = {}, {}
    for r in rules.matches(df, found).collect():
        got.setdefault(r.path, set()).add(r.rule)
        how[r.path, r.rule] = r.admission
    assert [got.get(f"/{i}.txt", set()) for i in range(len(texts))] == list(texts.values())
    assert got["/q.php"] == {"php"} and got["/q.bin"] == {"php"} and "/q.jsp" not in got and "/null.php" not in got
    assert how["/q.php", "php"] == "declared" and how["/q.bin", "php"] == "unknown-language" and how["/0.txt", "word"] == "undeclared"


PROBE = b"MZ hello World hello xhello <?php eval($_POST['a']); \x00w\x00i\x00d\x00e\x00"
CONDITIONS = [
    ('$a = "hello"', "#a == 3 and @a[2] == 15 and !a[1] == 5 and not defined @a[9]", True),
    ('$a = "hello" fullword', "#a == 2", True),
    ('$a = "HELLO"', "$a", False),
    ('$a = "HELLO" nocase', "$a", True),
    ('$a = "wide" wide', "$a", True),
    ('$a = "wide" ascii', "$a", False),
    ('$a = /w.d[e]/ wide', "$a", True),
    (r"$a = /ev[a]l\s*\(\$_(GET|POST)/", "$a", True),
    (r"$a = /WORLD/i $b = /\;\s$/", "$a and not $b", True),
    ('$a = "hello"', "$a in (10..20) and $a at 3 and for any i in (1..#a) : (@a[i] > 20)", True),
    ('$a = "hello" $b = "nope"', "1 of them and not all of them and 50% of them and none of ($b)", True),
    ('$a = "hello" $b = "World"', "for all of ($a, $b) : ($ at 3 or # == 1)", True),
    ('$a = { 4D 5A ?? 6? [0-4] (6C | 00) }', "$a at 0", True),
    ('$a = { 4D 5A ~20 }', "$a", False),
    ('$a = { ( 4D | 5A ) 5A [-] 65 6C }', "$a", True),
    ('$a = "idmmn" xor(1)', "$a", True),
    ('$a = "x"', "$a and filesize < 1KB and 2 + 3 * 2 == 8 and 7 % 4 == 3 and 9 \\ 2 == 4 and 1 << 4 == 16 and (5 & 3 | 8) == 9", True),
    ("", "uint32(1000) == 0 or defined uint8(2000)", False),
    ("", "uint16be(0) == 0x4D5A and int8(2) == 0x20", True),
    ("", "yes and not no and 1 of (y*) and all of (yes, also) and not all of (y*, no)", True),
    ("", f'hash.md5(0, 2) == "{hashlib.md5(b"MZ").hexdigest()}" and math.entropy(0, 1) == 0.0 and pe.is_pe == 0 and not defined pe.machine', True),
    ("", "for all i in (0, 1) : (uint8(i) > 0x40) and for 2 j in (1..3) : (j > 1)", True),
]


@pytest.mark.parametrize("i", range(len(CONDITIONS)))
def test_rule_conditions(i):
    strings, condition, holds = CONDITIONS[i]
    text = 'import "hash" import "math" import "pe" rule yes { condition: filesize > 2 } rule also { condition: true } rule no { condition: false } rule t { ' + (f"strings: {strings} " if strings else "") + f"condition: {condition} }}"
    pack = rules.rule_set(text).pack
    assert pack.holds(PROBE)[3] is holds
    assert ("t" in [pack.rules[k].name for k, _ in pack.scan(PROBE)]) is holds


BROKEN = [
    ("rule a { condition: $x }", "no string \\$x"),
    ('rule a { strings: $a = "x" condition: true }', "not used"),
    ("rule a { strings: $a = /(/ condition: $a }", "line 1: regex of \\$a"),
    ('rule a {\n strings:\n  $a = ""\n condition: $a }', "line 3: string \\$a is empty"),
    ("rule a { condition: b }", "no rule b"),
    ("rule a { condition: true } rule a { condition: true }", "declared twice"),
    ("rule a { condition: b } rule b { condition: a }", "refers to itself"),
    ('import "cuckoo" rule a { condition: true }', "not supported"),
    ("rule a { condition: entrypoint == 0 }", "not supported"),
    ("rule a { condition: true", "expected '}'"),
    ('rule a { strings: $a = { [2] 41 } condition: $a }', "begins and ends with bytes"),
    ('rule a { strings: $a = "x" base64("abc") condition: $a }', "not supported"),
]


@pytest.mark.parametrize("i", range(len(BROKEN)))
def test_broken_rules_say_why(i):
    with pytest.raises(ValueError, match=BROKEN[i][1]):
        rules.rule_set(BROKEN[i][0])


def test_global_rules_gate_and_references_come_in_any_order():
    pack = rules.rule_set('global rule small { condition: filesize < 10 } rule a { condition: b and c } rule b { strings: $x = "b" condition: $x } private rule c { condition: true }').pack
    names = lambda data: [pack.rules[k].name for k, _ in pack.scan(data)]
    assert sorted(names(b"abc")) == ["a", "b", "small"] and names(b"abc" * 9) == []


def test_atoms_lose_nothing(monkeypatch):
    """Matches with atoms are those without: every string of random packs over random data, by brute force of its pattern."""
    from vigilspark.operators.signatures import matcher

    rng = random.Random(3)
    parts = ["ab", "[cd]e", "(fg|hi)", "j+", "k{2,3}", "l?m", "(n|op)q", ".r", "s*"]
    for _ in range(30):
        strings = [("/" + "".join(rng.choices(parts, k=rng.randint(1, 4))) + "/" + rng.choice(["", "i"])) for _ in range(6)] + ['"' + "".join(rng.choices("abcdehk", k=rng.randint(1, 4))) + '"' + rng.choice(["", " nocase", " wide", " fullword"]) for _ in range(6)]
        strings = [s for s in strings if s not in ("/s*/", "/s*/i", "/s*s*/")]
        text = " ".join(f"rule r{i} {{ strings: $a = {s} condition: $a }} rule n{i} {{ strings: $a = {s} condition: not $a }}" for i, s in enumerate(strings))
        data = ["".join(rng.choices("abcdefghijklmnopqrs\x00AB", k=rng.randint(0, 60))).encode() for _ in range(20)]
        with_atoms = rules.rule_set(text).pack
        monkeypatch.setattr(matcher, "LEAST_ATOM", 99)
        without = rules.RuleSet((text,)).pack
        monkeypatch.undo()
        monkeypatch.setattr(matcher, "ahocorasick", None)
        one_by_one = rules.RuleSet((text,)).pack
        monkeypatch.undo()
        for d in data:
            want = [(k, s) for k, s in without.scan(d)]
            assert [(k, s) for k, s in with_atoms.scan(d)] == want == [(k, s) for k, s in one_by_one.scan(d)]
            assert with_atoms.holds(d) == without.holds(d)


def test_a_pack_file_end_to_end(spark, tmp_path):
    """Lines of a pack file → split → checked → a set → matches → findings."""
    from vigilspark.operators import library

    pack = 'import "hash"\n\nrule one : tag\n{\n meta:\n  score = 88\n  family = "F"\n  author = "me"\n  reference = "r"\n  own_cells = "A, B"\n strings:\n  $a = "needle"\n condition:\n  $a and two\n}\n\nprivate rule two { condition: filesize > 0 }\nrule three { condition: nobody }\nrule four { condition: }\n'
    lines = spark.createDataFrame([("p", i, line) for i, line in enumerate(pack.split("\n"))], "pack string, pos int, line string")
    split = library.split_pack(lines)
    status = {r.identifier or r.rule_no: (r.status, r.error) for r in rules.compile_status(split, "rule_no").collect()}
    assert status["one"] == status["two"] == ("ok", None) and status["three"] == ("unresolved", "no rule nobody") and status[4][0] == "failed"
    found = rules.rule_set_of(split.where("identifier in ('one', 'two')"))
    files = spark.createDataFrame([("/a.txt", "a needle"), ("/b.txt", "none")], "path string, text string")
    r = rules.findings(rules.matches(files, found), found).collect()
    assert [(x.path, x.rule, x.score, x.tier, x.family, x.author, x.reference, x.cells) for x in r] == [("/a.txt", "one", 88, "confirmed", "F", "me", "r", "A,B")]
    checked = rules.validate(files, found)
    assert {x.rule: x.hits for x in checked.collect()} == {"one": 1, "two": 2}
    assert rules.verdict(checked) == 1 and rules.verdict(None) == 3 and rules.verdict(checked.limit(0)) == 0 and rules.verdict(None, "broken") == 1


def test_own_pack(spark):
    from vigilspark.packs import own_rules

    found = own_rules()
    assert sum(not r.private for r in found.rules) >= 57 and not found.pack.always
    samples = {
        "a.php": ("<?php @eval($_POST['x']); ?>", "php_request_evaluated"),
        "b.php": ("<?php $f = 'sys' . 'tem'; $f($_GET['c']);", "php_name_from_pieces"),
        "c.jsp": ('<% Runtime.getRuntime().exec(request.getParameter("c")); %>', "jsp_request_to_process"),
        "d.aspx": ('<%@ Page Language="Jscript"%><%eval(Request.Item["x"],"unsafe");%>', "aspx_chopper_line"),
        "e.asp": ('<% Execute(Request("x")) %>', "asp_evaluates_request"),
        "f.pl": ("use CGI; my $c = param('c'); system(param('c'));", "perl_request_to_shell"),
        "g.py": ("import cgi, os\nos.system(cgi.FieldStorage()['c'].value)", "python_request_to_shell"),
        "h.shtml": ('<!--#exec cmd="$QUERY_STRING" -->', "ssi_command"),
        "i.txt": ("<?php system($_GET['c']);", "php_request_to_shell"),
        "j.php": ("<?php echo htmlspecialchars($_GET['name']); include 'header.php';", None),
        "k.jsp": ('<% out.println(request.getParameter("x")); %>', None),
    }
    files = spark.createDataFrame([(f"/{n}", t) for n, (t, _) in samples.items()], "path string, text string")
    got = {}
    for r in rules.matches(files, found).collect():
        got.setdefault(r.path[1:], set()).add(r.rule)
    for name, (_, rule) in samples.items():
        assert rule in got.get(name, set()) if rule else name not in got, (name, got.get(name))


def found_in(data):
    return [(m, d) for m, d in layers.decode(data).found]


FOLDS = [
    (b"a='sy'.'stem'; b", b"a='system'; b"),
    (b"x = 'ev' + \"al\" + 'x'", b"x = 'evalx'"),
    (b"chr(101).chr(0x76).'al'", b"'eval'"),
    (b"'x'.chr(101).chr(118)", b"'xev'"),
    (b"chr(101)", b"chr(101)"),
    (b"chr(300).chr(65)", b"chr(300).chr(65)"),
    (b"scalar reverse(\"metsys\") . 'x'", b"'systemx'"),
    (b"('l' . 'ave')[::-1]", b"('lave')[::-1]"),
    (b"'lave'[::-1]", b"'eval'"),
    (b"base64.b64decode('c3lzdGVt').decode()", b"'system'"),
    (b"__import__('base64').b64decode('c3lzdGVt')", b"'system'"),
    (b"b64decode('c3lzdGVt')", b"b64decode('c3lzdGVt')"),
    (b"decode_base64('c3lzdGVt')", b"'system'"),
    (b"bytes.fromhex('73797374656d').decode()", b"'system'"),
    (b"pack('H*', '73797374656d')", b"'system'"),
    (b"pack('H*', '7379737465')", b"'syste'"),
    (b"pack('N*', '73')", b"pack('N*', '73')"),
    (b"getattr(os, 'sys' + 'tem')(x)", b"os.system(x)"),
    (b"getattr(__import__('o' + 's'), 'system')('id')", b"os.system('id')"),
    (b"f = 'system'\nf('id')\n", b"f = 'system'\nsystem('id')\n"),
    (b"my $f = 'system';\n$f('x');\n", b"my $f = 'system';\nsystem('x');\n"),
    (b"n='system'\ngetattr(os, n)('x')\n", b"n='system'\nos.system('x')\n"),
    (b"f='system'\nf='other'\nf(1)\n", b"f='system'\nf='other'\nf(1)\n"),
    (b"don't 'a'.'b' isn't", b"don't 'ab' isn't"),
    (b"'a\\'b'.'c'", b"'a\\'bc'"),
    (b"decode_base64('AAAA')", b"decode_base64('AAAA')"),
    (b"", b""),
]


@pytest.mark.parametrize("i", range(len(FOLDS)))
def test_folding(i):
    assert folding.folded(FOLDS[i][0]) == FOLDS[i][1]


def test_folding_takes_anything():
    rng = random.Random(4)
    bits = [b"'", b'"', b".", b"+", b"(", b")", b"[", b"]", b":", b"-", b"1", b"chr", b"reverse", b"getattr", b"a", b"=", b"\n", b" ", b"\\", b"\xff", b",", b"$", b"65", b"0x41"]
    for _ in range(3000):
        data = b"".join(rng.choices(bits, k=rng.randint(0, 30)))
        assert isinstance(folding.folded(data), bytes)
    assert folding.folded(b"'a'." * 20_000 + b"'a'") == b"'" + b"a" * 20_001 + b"'"


def test_layers():
    inner = b"print('hello there, this is long enough')"
    b64 = base64.b64encode(inner)
    assert ("base64", inner) in found_in(b"eval(base64_decode('" + b64 + b"'))")
    packed = zlib.compress(inner)[2:-4]
    got = dict(found_in(b"x(gzinflate(base64_decode('" + base64.b64encode(packed) + b"')))"))
    assert got["gzinflate"] == inner
    assert ("chr", b"exec") in found_in(b"chr(101).chr(0x78).chr(101).chr(99)")
    assert not any(m == "chr" for m, _ in found_in(b"chr(101).chr(999).chr(101).chr(99)"))
    assert ("hex", b"system") in found_in(rb"'\x73\x79\x73\x74\x65\x6d'")
    assert found_in(b"%65%76%61%6c(1)")[0] == ("normalized", b"eval(1)")
    assert found_in(b"%41%42%43") == []
    assert ("folded", b"'system'") in found_in(b"'sys' . 'tem'")
    assert any(m == "folded" and b"os.system(" in d for m, d in found_in(b"n = 'system'\ngetattr(os, n)('x')"))
    deep = inner
    for _ in range(12):
        deep = b"eval(base64_decode('" + base64.b64encode(deep) + b"'))"
    r = layers.decode(deep)
    assert r.truncated and len(r.found) <= layers.MAX_LAYERS
    assert folding.strict_base64(b"YWJ") is None and layers.decode(b"").found == []


def test_layers_table(spark):
    df = spark.createDataFrame([("a", bytearray(rb"\x73\x79\x73\x74\x65\x6d\x00")), ("b", bytearray(b"plain")), ("c", None)], "path string, content binary")
    assert {(r.path, r.method) for r in layers.decoded_layers(df).collect()} >= {("a", "hex")}
    assert layers.decoded_layers(df.limit(0)).count() == 0


def test_ssi(spark):
    pages = {
        "a": '<!--#set var="x" value="$y" --><!--#set var="y" value="${QUERY_STRING}" --><!--#exec cmd="run $x" -->',
        "b": '<!--#exec cmd="ls" --><!--#include file="$HTTP_ANY" -->',
        "c": "<!--#set var='x' value='$DATE' --><!--#exec cmd='$x' -->",
        "d": '<!--#exec cgi="$PATH_INFO" cmd="$HTTP_X" -->',
        "e": "no directives",
    }
    got = {(r.path, r.rule, r.via) for r in ssi.findings(spark.createDataFrame(list(pages.items()), "path string, text string")).collect()}
    assert got == {("a", "ssitaint:exec-cmd-on-request", "x"), ("b", "ssitaint:include-file-on-request", "HTTP_ANY"), ("d", "ssitaint:exec-cmd-on-request", "HTTP_X")}


SCRIPTS = [
    ("a.pl", "#!/usr/bin/perl\nmy $q = param('x');\nmy ($a, $b) = split(/,/, $q);\nsystem($b);\n", "perlpytaint:sink-on-request"),
    ("a.pl", "#!/usr/bin/perl\nmy $q = 'x';\nsystem($q);\n", None),
    ("a.pl", "my $q = param('x');\nsub system ($q) { }\n", None),
    ("a.cgi", "#!/usr/bin/python3\nimport cgi\nf = cgi.FieldStorage()\nfor k in f:\n  eval(k)\n", "perlpytaint:sink-on-request"),
    ("a.asp", '<% Dim c : c = Request.Form("c")\nExecute(c) %>', "asptaint:sink-on-request"),
    ("a.asp", '<% c = CInt(Request("c"))\nExecute c %>', None),
    ("a.asp", '<% \' Execute Request("c")\nx = 1 %>', None),
    ("a.asp", '<% Set s = Server.CreateObject("WScr" & "ipt.Shell")\ns.Run Request("x") %>', "asptaint:sink-on-request"),
    ("a.jsp", '<% String a = request.getParameter("a"); String b = a.trim(); new ProcessBuilder(b).start(); %>', "javadisk:request-exec"),
    ("a.jsp", '<% /* request.getParameter("a") */ Runtime.getRuntime().exec("date"); %>', None),
    ("a.jsp", '<% byte[] d = decode(request.getParameter("a")); defineClass(d, 0, d.length); %>', "javadisk:dynamic-classload"),
    ("a.php", "<?php $x = $_POST['x']; $y = base64_decode($x); eval($y); ?>", "phptaint:sink-on-request"),
    ("a.php", "<?php $f = 'ass' . 'ert'; $f($_GET['c']); ?>", "phptaint:sink-on-request"),
    ("a.php", "<?php // eval($_GET['x']);\necho 'eval($_GET)'; ?>", None),
    ("a.php", "<?php $o->system($_GET['x']); ?>", None),
    ("a.php", "<?php file_put_contents($_GET['f'], $_POST['d']); ?>", "phptaint:file-drop-on-request"),
    ("note.txt", "<?php system($_GET['x']); ?>", "phptaint:sink-on-request"),
    ("note.txt", "system($_GET['x'])", None),
    ("a.jsp", "<?php system($_GET['x']); ?>", None),
    ("run", "#!/usr/bin/perl\nuse CGI;\nsystem(param('x'));\n", "perlpytaint:sink-on-request"),
    ("a.pl", "read(STDIN, my $buf, $ENV{CONTENT_LENGTH});\n@p = split(/&/, $buf);\nforeach $x (@p) { my $r = `$x`; }\n", "perlpytaint:sink-on-request"),
    ("a.pl", "my $c = $ENV{'QUERY_STRING'};\nopen(F, \"$c|\");\n", "perlpytaint:sink-on-request"),
    ("a.pl", "my $c = $ENV{QUERY_STRING};\nprint \"$c\";\n", None),
    ("a.py", "import os, subprocess\nx = os.environ['QUERY_STRING']\ny = subprocess.check_output(x.split('=')[1], shell=True)\n", "perlpytaint:sink-on-request"),
    ("a.py", "q = request.args.get('c')\nobj.eval(q)\n", None),
]


@pytest.mark.parametrize("i", range(len(SCRIPTS)))
def test_scripts(spark, i):
    path, text, rule = SCRIPTS[i]
    files = spark.createDataFrame([(path, text)], "path string, text string")
    got = {r.knowledge_ref for r in scripts.all_findings(files).collect()}
    assert got == ({rule} if rule else set())


PHP = [
    ('sink-on-request', 85, '<?php $run = "passthru"; $run($_GET["v"]);'),
    ('sink-on-request', 85, '<?php $run = chr(112).chr(0x6f)."pen"; $run($_COOKIE["v"]);'),
    ('sink-on-request', 85, "<?php $table['go'] = 'shell_exec'; $table['go']($_POST['v']);"),
    ('sink-on-request', 85, '<?php ${"line"} = $_REQUEST["v"]; exec($line);'),
    ('sink-on-request', 90, '<?php eval(${"_RE"."QUEST"}["v"]);'),
    ('sink-on-request', 85, '<?= `ls $_GET[v]` ?>'),
    ('sink-on-request', 80, "<?php require_once $_GET['page'] . '.html';"),
    ('sink-on-request', 85, "<?php $m = new ReflectionMethod($_POST['c'], $_POST['m']);"),
    ('sink-on-request', 85, '<?php $v = getenv("HTTP_X_TODO"); popen($v, "r");'),
    ('sink-on-request', 90, "<?php $all = apache_request_headers(); eval($all['todo']);"),
    ('sink-on-request', 90, '<?php $body = file_get_contents("php://input"); eval($body);'),
    ('sink-on-request', 85, '<?php $run = ("%"^"@").("8"^"@").("%"^"@").("#"^"@"); $run($_POST["v"]);'),
    ('sink-on-request', 85, '<?php $run = ~~exec; $run($_POST["v"]);'),
    ('sink-on-request', 85, "<?php $line = <<<DOC\nfind {$_GET['v']}\nDOC;\nsystem($line);"),
    ('sink-on-request', 85, "<?php final class Job { protected function go(?int $n = 3): ?string { return shell_exec($_POST['v']); } }"),
    ('sink-on-request', 85, "<?php while ($n): passthru($_GET['v']); endwhile;"),
    ('sink-on-request', 85, "<?php odd ( ; system($_GET['v']);"),
    ('dynamic-dispatch-on-request', 75, "<?php $run = pick(); $run($_GET['v']);"),
    ('forwarder-obfuscated-callee', 80, "<?php $tail = substr($_SERVER['HTTP_USER_AGENT'], 3, 2); forward_static_call($tail . 'tem', $_GET['v']);"),
    ('forwarder-obfuscated-callee', 80, "<?php $run = pack('H*', $half) ^ $mask; array_diff_uassoc([$_GET['v'] => 1], [2], $run);"),
    ('nibble-assembler-loop', 70, '<?php foreach ($halves as $two) { $out .= chr(($two[0] << 4) + $two[1]); }'),
    ('unbound-callback-dispatch', 75, "<?php $rows = [$_POST['v']]; array_uintersect($rows, [2], $nowhere);"),
    ('callback-on-request', 85, "<?php usort($_POST['v'], 'assert');"),
    ('request-tainted-callback', 78, "<?php array_map($_GET['f'], [$_GET['v']]);"),
    ('com-exec-on-request', 90, "<?php $box = new COM('WScript.Shell'); $box->Run('tool ' . $_GET['v']);"),
    ('sql-registered-callable', 85, "<?php $db->sqliteCreateFunction('go', 'exec');"),
    ('sql-registered-callable', 80, "<?php $db->createAggregate('go', strrev($x) . 'y');"),
    ('file-drop-on-request', 70, '<?php file_put_contents("cache/new.phtml", $_POST["v"]);'),
    ('arbitrary-file-write', 85, "<?php $h = fopen($_GET['where'], 'ab'); fputs($h, $_POST['v']);"),
    ('decode-loop-dispatch', 80, "<?php function undo($t) { $r = ''; foreach (str_split($t) as $c) { $r .= chr(ord($c) - 1); } return $r; } $go = undo('tztufn'); $go('ls');"),
    (None, 0, "<?php call_user_func('strlen', $_GET['v']);"),
    (None, 0, '<?php system(getenv("LANG")); eval(file_get_contents("local.inc"));'),
    (None, 0, "<?php $by = fn($x, $y) => $x <=> $y; usort($_POST['v'], $by);"),
    (None, 0, "<?php function each_of($go) { return array_map($go, $_POST['v']); }"),
    (None, 0, "<?php foreach ($all as $n => $go) { array_filter($_POST['v'], $go); } try { f(); } catch (Err $go2) { array_map($go2, $_POST['v']); }"),
    (None, 0, "<?php [$x, $go] = $two; array_map($go, $_POST['v']); extract($more); array_map($other, $_POST['v']);"),
    (None, 0, "<?php array_map($known[$_GET['which']], $_POST['v']);"),
    (None, 0, "<?php move_uploaded_file($_FILES['v']['tmp_name'], 'images/' . basename($_FILES['v']['name']));"),
    (None, 0, "<?php $v = $_GET['v']; $v = 'fixed'; exec($v); $db->query('select ' . $_GET['v']);"),
    (None, 0, "<?php assert($v !== null && $_GET['v'] > 2); $out .= chr(1 << 4);"),
    (None, 0, "<?php # eval($_GET['v'])\n// `$_GET[v]`\nprint 'system($_GET)'; /* exec($_POST['v']) */"),
    (None, 0, ''),
]


@pytest.mark.parametrize("i", range(len(PHP)))
def test_php(i):
    rule, score, text = PHP[i]
    got = {(r.split(":")[1], n) for r, _, n, _ in php.analyse(text)}
    assert (rule, score) in got if rule else not got


def test_php_takes_anything():
    rng = random.Random(6)
    bits = ["<?php ", "$a", "$_GET['x']", "(", ")", "{", "}", "[", "]", ";", "system", "eval", "'", '"', "`", "=", ".=", "=>", "->", "::", "function", "if", "else", "foreach", "as", "new", "<<<EOT\n", "EOT;", "?>", "\\", "$", "1", "<<", "case", "class", "//", "/*", "fn", "match", "static", ",", "&"]
    for _ in range(3000):
        list(php.analyse("<?php " + " ".join(rng.choices(bits, k=rng.randint(0, 25)))))
    list(php.analyse("<?php $a = " + "(" * 5000 + "1" + ")" * 5000 + "; system($_GET['x']);"))
    assert list(php.analyse("<?php " + "$a = 'x' . $a;\n" * 20_000 + "system($_GET['x']);"))


ASP = [
    (True, '<% todo = Request("todo") %> some markup <% Execute(todo) %>'),
    (True, '<%\nDim job\n\' a remark\njob = Request("job")\nExecute(job)\n%>'),
    (True, '<%ExecuteGlobal(Request.Form("z"))%>'),
    (True, '<%\nSet host = CreateObject("ScriptControl")\nhost.Language = "VBScript"\nhost.AddCode Request("lines")\n%>'),
    (True, '<%\nSet host = Server.CreateObject("MSScriptControl.ScriptControl.1")\nhost.Eval(Request("line"))\n%>'),
    (True, '<% v = Request("v") : Eval v %>'),
    (True, '<%\nv = _\n Request.QueryString("v")\nw = v\nz = w & " "\nEval(z)\n%>'),
    (True, '<%\nViA = rEQUest("v")\nEXECUTE vIa\n%>'),
    (True, '<%\nv = "if " & Request("v") & " then"\nExecute v\n%>'),
    (True, '<%\nv = Request.ServerVariables("HTTP_X_TODO")\nExecute v\n%>'),
    (True, '<%\nSession("later") = Request("v")\nExecute Session("later")\n%>'),
    (True, '<%\nall = Request.QueryString\nFor Each one In all\nExecuteGlobal one\nNext\n%>'),
    (True, '<%\nIf Request("v") <> "" Then v = Request("v")\nExecute v\n%>'),
    (True, '<%\nResponse.Write "it\'s <b class=\'x\'>"\nv = Request("v")\nExecute v\n%>'),
    (True, '<%\nu = w\nw = y\ny = u & Request("v")\nExecute u\n%>'),
    (True, '<%\nSub Main()\nline = Request("line")\nEval line\nEnd Sub\n%>'),
    (True, '<%\nline = Request("line")\nSub Main()\nEval line\nEnd Sub\n%>'),
    (True, '<%\nFunction Fetch()\nFetch = Request("v")\nEnd Function\ngot = Fetch()\nExecute got\n%>'),
    (True, '<%\nv = Request("v")\nSub Other(x)\nDim v\nv = x\nEnd Sub\nExecute v\n%>'),
    (True, '<%\nSet host = CreateObject("ScriptControl")\nhost.ExecuteStatement("ex" & "ecute(request(""v""))")\n%>'),
    (True, '<object runat="server" id="box" classid="clsid:72C24DD5-D70A-438B-8A42-98424B88AFB8"></object><% Response.Write box.Exec("where " & Request("v")).StdOut.ReadAll %>'),
    (True, '<object runat=server id=box classid="clsid:F935DC22-1CF0-11D0-ADB9-00C04FD58A0B"></object><% box.Run Request("v") %>'),
    (True, '<object id=box progid="Shell.Application" runat=server></object><% box.ShellExecute Request("v") %>'),
    (True, '<%\nSet box = Server.CreateObject("WS" & "cript.Sh" & "ell")\nbox.Run Request("v"), 0\n%>'),
    (True, '<% CreateObject("WScript.Shell").Exec(Request("v")) %>'),
    (True, '<%\nSet disk = CreateObject("Scripting.FileSystemObject")\nSet page = disk.CreateTextFile(Server.MapPath("new.aspx"))\npage.WriteLine Request("body")\n%>'),
    (True, '<%\nbody = Request("body")\nSet disk = CreateObject("Scripting.FileSystemObject")\nSet page = disk.OpenTextFile(Request("where"), 2, True)\npage.Write(body)\n%>'),
    (True, '<%\nSet tape = CreateObject("ADODB." & "Stream")\ntape.WriteText Request.Form("body")\ntape.SaveToFile Server.MapPath("new.cer"), 2\n%>'),
    (True, '<%\nwho = Request("who")\nSet disk = CreateObject("Scripting.FileSystemObject")\nSet log = disk.OpenTextFile(Server.MapPath("visits") & ".log", 8)\nlog.WriteLine "seen " & who\n%>'),
    (True, '<%@ Page Language="JScript" %><% eval(Request["v"], "unsafe"); %>'),
    (True, '<script runat="server">\nvoid Load() {\n  string v = Request.Form["v"];\n  Process.Start("tool", v);\n}\n</script>'),
    (False, '<%\nv = "fixed"\nExecute v\n%>'),
    (False, '<%\nv = Request("v")\nResponse.Write v\n%>'),
    (False, '<%\nv = Request("v")\nExecute "x = 1"\n%>'),
    (False, '<%\nv = 1\n\' v = Request("v")\nExecute v\n%>'),
    (False, '<%\nv = 1\nREM v = Request("v")\nExecute v\n%>'),
    (False, '<%\nq = Request("q")\nSet db = CreateObject("ADODB.Connection")\ndb.Execute q\n%>'),
    (False, '<%\nv = Request("v")\nServer.Execute v\n%>'),
    (False, '<%\nIf v = Request("v") Then\nResponse.Write 1\nEnd If\nExecute v\n%>'),
    (False, '<%\nDo While v = Request("v")\nLoop\nExecute v\n%>'),
    (False, '<%\nv = CLng(Request("v"))\nExecute v\n%>'),
    (False, '<%\nExecute "n = " & CInt(Request("n"))\n%>'),
    (False, '<%\nv = Request("v")\nFunction Execute(t)\nExecute = t\nEnd Function\n%>'),
    (False, '<%\nwhole = Request("v")\nExecute who\n%>'),
    (False, '<%\nv = Request("v")\nSet box = CreateObject("My.Thing")\nbox.AddCode v\n%>'),
    (False, '<%\nResponse.Redirect "https://host.test/x?y=1"\nz = Request("z")\n%>'),
    (False, '<%\nv = Request("v")\nFunction Run(v)\nExecute v\nEnd Function\n%>'),
    (False, '<%\npart = Request("part")\nSub Each1(list)\nDim part\nFor Each part In list.Items\nExecute("list." & part)\nNext\nEnd Sub\n%>'),
    (False, '<%\nkind = LCase(Request("kind"))\nExecute "Show" & kind & "()"\n%>'),
    (False, '<%\nbits = Split(Request("v"), ",")\nExecute("n=" & bits(1))\n%>'),
    (False, '<object id=box classid="clsid:72C24DD5-D70A-438B-8A42-98424B88AFB8"></object><% box.Run Request("v") %>'),
    (False, '<%\nSet disk = CreateObject("Scripting.FileSystemObject")\nSet page = disk.CreateTextFile(Server.MapPath("now.asp"))\npage.Write Now()\nv = Request("v")\n%>'),
    (False, '<%\nv = Request("v")\nCall SaveToFile("dir/now.asp", v)\n%>'),
    (False, '<%\nSet out = New Report\nout.Write Request("v")\nout.SaveToFile "now.asp"\n%>'),
]


@pytest.mark.parametrize("i", range(len(ASP)))
def test_asp(i):
    found, text = ASP[i]
    got = list(asp.analyse(text))
    assert bool(got) == found and len({(r, e) for r, _, _, e in got}) == len(got)


def test_asp_takes_anything():
    rng = random.Random(9)
    bits = ["<%", "%>", "a", "=", "Request", "(", ")", '"x"', '"', "'", ":", "\n", "&", "Execute", ".", "If", "Then", "Sub", "End", "Function", "Dim", "_\n", "rem", "CreateObject", "Write", "[", "]", ",", "Call", "Set"]
    for _ in range(3000):
        list(asp.analyse("<% request " + " ".join(rng.choices(bits, k=rng.randint(0, 30)))))
    assert list(asp.analyse("<% a = Request(\"c\")\n" + "b = a & \"x\"\n" * 20_000 + "Execute a %>"))
    list(asp.analyse("<% x = request" + "(" * 50_000 + "." * 50_000))


def utf(s):
    raw = s.encode()
    return b"\x01" + struct.pack(">H", len(raw)) + raw


def class_file(owner, name, own="Evil"):
    """A class with one method that calls owner.name."""
    pool = [utf(own), b"\x07\x00\x01", utf("java/lang/Object"), b"\x07\x00\x03", utf(owner), b"\x07\x00\x05", utf(name), utf("()V"), b"\x0c\x00\x07\x00\x08", b"\x0a\x00\x06\x00\x09", utf("go"), utf("Code")]
    code = b"\x00\xb8\x00\x0a\xb1"
    attribute = struct.pack(">HHI", 2, 2, len(code)) + code + b"\x00\x00\x00\x00"
    method = struct.pack(">HHHH", 9, 11, 8, 1) + struct.pack(">HI", 12, len(attribute)) + attribute
    return b"\xca\xfe\xba\xbe\x00\x00\x00\x34" + struct.pack(">H", len(pool) + 1) + b"".join(pool) + struct.pack(">HHHHHH", 1, 2, 4, 0, 0, 1) + method + b"\x00\x00"


def test_class_files(spark):
    data = class_file("javax/servlet/ServletContext", "addFilter")
    assert classfile.read_class(data) == ("Evil", [("go()V", "javax/servlet/ServletContext", "addFilter", "()V")])
    # goto past a call; a return before one; a handler
    assert [a for a, _ in classfile.reachable(b"\xa7\x00\x06\xb8\x00\x0a\xb1", [])] == [0, 6]
    assert [a for a, _ in classfile.reachable(b"\x00\xb1\xb8\x00\x0a\xb1", [])] == [0, 1]
    assert [a for a, _ in classfile.reachable(b"\x00\xb1\xb8\x00\x0a\xb1", [(0, 1, 2)])] == [0, 1, 2, 5]
    switch = b"\xaa\x00\x00\x00" + struct.pack(">iiiii", 24, 0, 1, 25, 26) + b"\xb1\xb1\xb1"
    assert [a for a, _ in classfile.reachable(switch, [])] == [0, 24, 25, 26]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("WEB-INF/classes/Evil.class", data)
        z.writestr("../x.class", data)
        z.writestr("bad.class", data[:40])
        z.writestr("big.class", b"\x00" * (2 << 20), zipfile.ZIP_DEFLATED)
    found, problems = classfile.calls(spark.createDataFrame([("/a.war", bytearray(held.getvalue())), ("/b.jar", bytearray(b"junk")), ("/c.class", bytearray(data))], "path string, content binary"))
    assert {(r.path, r.rule) for r in classfile.structural(found).collect()} == {("/a.war", "javadisk:class-hook-registration-structure"), ("/c.class", "javadisk:class-hook-registration-structure")}
    assert {(r.artifact, r.code) for r in problems.collect()} == {("/a.war!/../x.class", "java-artifact-read-failed"), ("/a.war!/bad.class", "java-class-malformed"), ("/a.war!/big.class", "java-archive-budget-exhausted"), ("/b.jar", "java-artifact-read-failed")}
    assert classfile.exploded(classfile.RATIO_FLOOR * 300, classfile.RATIO_FLOOR) and not classfile.exploded(classfile.RATIO_FLOOR * 200, classfile.RATIO_FLOOR)


def zipped(*members, **kw):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", **kw) as z:
        for name, data in members:
            z.writestr(name, data)
    return held.getvalue()


def test_archives_are_read_strictly():
    good = zipped(("b.txt", b"two"), ("A.class", b"one" * 500), ("a/", b""), compression=zipfile.ZIP_DEFLATED)
    found = archive.members(good, lambda n: not n.endswith(".class"))
    assert [(m.name, m.error) for m in found] == [("A.class", None), ("a/", None), ("b.txt", None)]
    assert archive.read(good, found[0]) == b"one" * 500 and archive.read(good, found[2]) == b"two"

    class Pipe(io.RawIOBase):  # no seeking: sizes come after the data
        def __init__(self):
            self.held = b""

        def writable(self):
            return True

        def write(self, b):
            self.held += bytes(b)
            return len(b)

    pipe = Pipe()
    with zipfile.ZipFile(pipe, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.txt", b"streamed" * 20)
    m = archive.members(pipe.held)[0]
    assert m.flags & archive.DESCRIBED and m.error is None and archive.read(pipe.held, m) == b"streamed" * 20
    at = pipe.held.rfind(archive.DESCRIPTOR)
    assert archive.members(pipe.held[: at + 4] + b"\x01" + pipe.held[at + 5 :])[0].error == "descriptor disagrees"

    plain = zipped(("x.txt", b"payload"))
    local, central = plain.find(archive.LOCAL), plain.find(archive.CENTRAL)
    swap = lambda data, at, new: data[:at] + new + data[at + len(new) :]
    assert archive.members(swap(plain, local + 30, b"y"))[0].error == "headers disagree"
    assert archive.members(swap(plain, local + 22, b"\x08"))[0].error == "headers disagree"
    assert archive.members(swap(plain, local, b"XX"))[0].error == "no local header"
    m = archive.members(swap(plain, local + 35, b"Q"))[0]
    with pytest.raises(ValueError):
        archive.read(swap(plain, local + 35, b"Q"), m)
    for bad in (b"", b"PK", plain[:-1], plain + plain[plain.find(archive.END) :], swap(plain, central, b"XX"), swap(plain, len(plain) - 14, b"\x07"), plain + b"x"):
        with pytest.raises(archive.BadArchive):
            archive.members(bad)
    two = zipped(("x.txt", b"payload"), ("y.txt", b"payload"))
    second = two.find(archive.CENTRAL, two.find(archive.CENTRAL) + 1)
    assert {m.error for m in archive.members(swap(two, second + 42, b"\0\0\0\0"))} <= {"headers disagree", "members overlap", None}
    big = zipped(("x.bin", b"z" * 100))
    with zipfile.ZipFile(io.BytesIO(), "w"):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z, z.open("x.bin", "w", force_zip64=True) as f:
            f.write(b"z" * 100)
    m = archive.members(held.getvalue())[0]
    assert m.error is None and archive.read(held.getvalue(), m) == b"z" * 100 and archive.members(big)[0].size == 100


def test_colliding_names_are_one_error():
    data = class_file("a/B", "c")
    jar = zipped(("X.class", data), ("x.class", data), ("Y.class", data))
    got = list(classfile.classes_in(jar, "j"))
    assert [(a, raw is not None, p) for a, raw, p in got] == [("j!/X.class", False, "java-artifact-read-failed"), ("j!/Y.class", True, None)]


def test_contracts_are_checked():
    from vigilspark.operators import memory

    good = {"java": {"pipeline_contracts": ["a.B"], "type_needles": ["x"], "string_needles": ["y"]}, "dotnet": {"pipeline_contracts": ["I"], "capability_apis": ["p"], "string_needles": ["q"]}}
    assert memory.load_contracts(json.dumps(good))["java"]["pipeline_contracts"] == ("a.B",)
    bad = json.loads(json.dumps(good))
    bad["java"]["type_needles"], bad["dotnet"]["capability_apis"] = [], [" "]
    del bad["dotnet"]["string_needles"]
    with pytest.raises(ValueError, match="java.type_needles is empty; dotnet.capability_apis holds an empty entry; dotnet.string_needles is empty"):
        memory.load_contracts(json.dumps(bad))
    for text in ("{", "[]", "{}"):
        with pytest.raises(ValueError):
            memory.load_contracts(text)


def test_generated_classes(spark):
    rows = [
        ("a$$EnhancerBySpringCGLIB$$1", ["CGLIB$x"], ["com.A", "java.lang.Object"], [], False, False, True),
        ("a$$EnhancerBySpringCGLIB$$1", ["x"], ["com.A"], [], False, False, False),
        ("a$$EnhancerBySpringCGLIB$$1", ["CGLIB$x"], ["java.lang.Object"], [], False, False, False),
        ("a$$FastClassByGuice$$1", ["GUICE$T"], ["java.lang.Object"], [], False, False, True),
        ("p_jsp", ["_jspService"], ["org.apache.jasper.runtime.HttpJspBase"], [], False, False, True),
        ("p_jsp", [], ["org.apache.jasper.runtime.HttpJspBase"], [], False, False, False),
        ("G", ["$getStaticMetaClass"], [], ["groovy.lang.GroovyObject"], False, False, True),
        ("P", [], [], [], True, False, True),
        ("N", None, None, None, False, False, False),
    ]
    df = spark.createDataFrame(rows, "name string, members array<string>, superclasses array<string>, interfaces array<string>, proxy boolean, hidden boolean, want boolean")
    got = df.select("want", classcode.verified_generated(*(F.col(c) for c in df.columns[:6])).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_large_regions_make_few_rows(spark):
    from vigilspark.operators import memory

    regions = spark.createDataFrame([(1, 0, 1 << 40), (1, 1 << 41, 4096), (2, (1 << 62) - 5, 1 << 60), (1, 3, 1)], "pid int, base long, size long")
    points = spark.createDataFrame([(1, 5), (1, (1 << 40) - 1), (1, 1 << 40), (1, (1 << 41) + 4095), (1, (1 << 41) + 4096), (2, 1 << 62), (1, 3)], "pid int, at long")
    got = memory.interval_join(regions, points, ["pid"], "base", "size", "at")
    assert {(r.base, r.at) for r in got.collect()} == {(0, 5), (0, (1 << 40) - 1), (0, 3), (3, 3), (1 << 41, (1 << 41) + 4095), ((1 << 62) - 5, 1 << 62)}
    rows = regions.where(F.col("size") == 1 << 40)
    level = memory._level("size", memory.BUCKET)
    spread = rows.select(F.size(F.sequence(memory._bucket("base", memory.BUCKET, level), memory._bucket("base + size - 1", memory.BUCKET, level))).alias("n")).first().n
    assert spread <= 2
    a = regions.select("pid", F.col("base").alias("l_start"), (F.col("base") + F.col("size")).alias("l_end"))
    b = regions.select("pid", F.col("base").alias("r_start"), (F.col("base") + F.col("size")).alias("r_end"))
    pairs = sorted((r.l_start, r.r_start) for r in memory.overlap_join(a, b, ["pid"]).collect())
    assert pairs == sorted([(0, 0), (0, 3), (3, 0), (3, 3), (1 << 41, 1 << 41), ((1 << 62) - 5, (1 << 62) - 5)])


def test_long_match_lines_are_quarantined(spark, tmp_path, monkeypatch):
    from vigilspark.sources import readers

    monkeypatch.setattr(readers, "MATCH_LINE_LIMIT", 200)
    good = '{"path": "/a", "rules": [{"identifier": "r", "namespace": "n", "meta": [], "strings": []}]}'
    (tmp_path / "m.ndjson").write_text(good + "\nbroken\n" + '{"path": "' + "x" * 300 + '"}\n')
    found, bad = readers.engine_matches(spark, str(tmp_path / "m.ndjson"))
    assert [r.rule for r in found.collect()] == ["r"] and sorted(r.line[:9] for r in bad.collect()) == ["broken", '{"path": ']


def test_over_limit_files_are_told(spark):
    files = spark.createDataFrame([("/a.php", "<?php " + "x" * 100), ("/b.pl", "y" * 100), ("/c.html", "z" * 100), ("/d.txt", "<?php " + "x" * 100)], "path string, text string")
    got = {(r.path, r["pass"], r.bytes) for r in scripts.skipped(files, dict.fromkeys(scripts.LIMITS, 50)).collect()}
    assert got == {("/a.php", "php", 106), ("/b.pl", "cgi", 100), ("/d.txt", "php", 106)}


def test_resolved_calls():
    got = dict(layers.decode(b"<?php $a = 'sys' . 'tem'; $a($_GET['x']); ?>").found)
    assert b"system($_GET['x'])" in got["php-resolved:system"]
    assert "php-resolved:system" not in dict(layers.decode(b"<?php $a = 'system'; $a = 'x'; $a(1);").found)


def test_rescan(spark):
    from vigilspark.operators import scan

    inner = base64.b64encode(b"this holds the secret marker, and more").decode()
    found = rules.rule_set('rule marker { meta: lang = "php" strings: $a = "secret marker" condition: $a } rule plain { strings: $a = "decode" condition: $a }')
    files = spark.createDataFrame([("/a.php", f"<?php eval(base64_decode('{inner}'));"), ("/a.jsp", f"eval(base64_decode('{inner}'))"), ("/b.php", "secret marker")], "path string, content string")
    got = {(r.path, r.rule, r.decoded, r.method) for r in scan.rescan(files, found).collect()}
    assert got == {("/a.php", "marker", True, "base64"), ("/a.php", "plain", False, None), ("/a.jsp", "plain", False, None), ("/b.php", "marker", False, None)}


def test_clones(spark):
    from vigilspark.operators import clones

    files = spark.createDataFrame([("a", "if (x == 1) { y('q'); }"), ("b", "if (foo==22){bar(\"z\");} /* c */"), ("c", "while (x) { y(); }"), ("d", "")], "path string, text string")
    g = clones.groups(clones.fingerprints(files)).collect()
    assert [(r.first_path, r.files, r.variants) for r in g] == [("a", 2, 2)]


def test_builds_and_settings(spark):
    from vigilspark.operators import scan

    always = spark.createDataFrame([("core",)], "file string")
    parts = spark.createDataFrame([("disk", "binary", "d", True), ("disk", "data", "rules.dat", True), ("mem", "binary", "m", False), ("mem", "data", "m.dat", False)], "view string, kind string, file string, rules boolean")
    files, needs = scan.build_files(always, parts, ["disk", "mem"])
    assert [r.file for r in files.collect()] == ["core", "d", "m", "m.dat"] and needs
    for views in ([], ["other"]):
        with pytest.raises(ValueError):
            scan.build_files(always, parts, views)
    with pytest.raises(ValueError):
        scan.build_files(spark.createDataFrame([("../x",)], "file string"), parts, ["mem"])
    assert scan.configure({"a": 1}, {"a": 2, "b": 3}, {"a": 0, "b": 0, "c": None}) == {"a": 1, "b": 3, "c": None}
    with pytest.raises(ValueError):
        scan.configure({"z": 1}, {}, {"a": 0})


def assembled(own, methods):
    """A class from [(flags, name, descriptor, locals, code with ("owner", "name", "descriptor") for references and str for
    class names)]."""
    pool, at = [], {}

    def add(entry):
        if entry not in at:
            pool.append(entry)
            at[entry] = len(pool)
        return at[entry]

    def text(x):
        return add(utf(x))

    def named(x):
        return add(b"\x07" + struct.pack(">H", text(x)))

    def ref(owner, name, descriptor):
        pair = add(b"\x0c" + struct.pack(">HH", text(name), text(descriptor)))
        return add(b"\x0a" + struct.pack(">HH", named(owner), pair))

    this, parent, code_name = named(own), named("java/lang/Object"), text("Code")
    out = b""
    for flags, name, descriptor, max_locals, parts in methods:
        code = b"".join(struct.pack(">H", ref(*p)) if isinstance(p, tuple) else struct.pack(">H", named(p)) if isinstance(p, str) else p for p in parts)
        attribute = struct.pack(">HHI", 8, max_locals, len(code)) + code + b"\x00\x00\x00\x00"
        out += struct.pack(">HHHH", flags, text(name), text(descriptor), 1) + struct.pack(">HI", code_name, len(attribute)) + attribute
    return b"\xca\xfe\xba\xbe\x00\x00\x00\x34" + struct.pack(">H", len(pool) + 1) + b"".join(pool) + struct.pack(">HHHHHH", 1, this, parent, 0, 0, len(methods)) + out + b"\x00\x00"


REQUEST = ("javax/servlet/http/HttpServletRequest", "getParameter", "(Ljava/lang/String;)Ljava/lang/String;")
EXEC = ("java/lang/Runtime", "exec", "(Ljava/lang/String;)Ljava/lang/Process;")
BUILDER = "java/lang/StringBuilder"
APPEND = (BUILDER, "append", "(Ljava/lang/String;)Ljava/lang/StringBuilder;")


def test_bytecode_taint(spark):
    from vigilspark.operators.taint import bytecode

    taken = [b"\x2b\x01\xb6", REQUEST]  # request.getParameter(null)
    direct = assembled("A", [(1, "go", "(LR;)V", 3, [*taken, b"\x4d\x01\x2c\xb6", EXEC, b"\x57\xb1"])])
    fixed = assembled("A", [(1, "go", "(LR;)V", 3, [*taken, b"\x4d\x01\x01\xb6", EXEC, b"\x57\xb1"])])
    built = assembled("A", [(1, "go", "(LR;)V", 4, [b"\xbb", BUILDER, b"\x59\xb7", (BUILDER, "<init>", "()V"), b"\x4e\x2d", *taken, b"\xb6", APPEND, b"\x57\x01\x2d\xb6", (BUILDER, "toString", "()Ljava/lang/String;"), b"\xb6", EXEC, b"\x57\xb1"])])
    through = [
        assembled("A", [(1, "go", "(LR;)V", 2, [*taken, b"\xb8", ("B", "pass", "(Ljava/lang/String;)Ljava/lang/String;"), b"\xb8", ("B", "run", "(Ljava/lang/String;)V"), b"\xb1"])]),
        assembled("B", [(9, "pass", "(Ljava/lang/String;)Ljava/lang/String;", 1, [b"\x2a\xb0"]), (9, "run", "(Ljava/lang/String;)V", 1, [b"\x01\x2a\xb6", EXEC, b"\x57\xb1"])]),
    ]
    branch = assembled("A", [(1, "go", "(LR;)V", 3, [b"\x01\x4d\x2b\xc6\x00\x09", *taken, b"\x4d\x01\x2c\xb6", EXEC, b"\x57\xb1"])])
    sinks = lambda classes: {(c, s) for c, _, s, _ in bytecode.analyse(classes)}
    assert sinks([direct]) == sinks([built]) == sinks([branch]) == {("A", "exec")} and sinks([fixed]) == set()
    assert sinks(through) == {("A", "exec")} and sinks(through[1:]) == set()
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for i, c in enumerate(through):
            z.writestr(f"{i}.class", c)
    df = spark.createDataFrame([("/a.jar", bytearray(held.getvalue())), ("/f.class", bytearray(fixed)), ("/x.class", bytearray(direct[:60]))], "path string, content binary")
    assert [(r.path, r.rule, r["class"], r.score) for r in bytecode.semantic(df).collect()] == [("/a.jar", "javadisk:class-request-exec", "A", 85)]
    assert bytecode.slots("(J[D[[Ljava/lang/String;I)D") == ([2, 1, 1, 1], 2)


def test_rules_of_one_condition_are_tried_together(spark):
    """a pack of like rules gives what each rule gives by itself, and looks a string up once, whatever rules share it."""
    from vigilspark.operators.signatures import matcher

    words = ["alpha", "Beta", "x", "gamma"]
    texts = [f'rule r{i} {{ strings: $a = "{words[i % 4]}" nocase $b = "{words[i // 4 % 4]}" fullword $n = "{i}" fullword condition: $a and not $b or #n > 1 and filesize < 40 }}' for i in range(64)]
    texts.append('rule z { strings: $a = "beta" condition: $a at 0 and r1 }')
    found = rules.rule_set(*texts)
    data = [b"", b"alpha beta", b"Beta alpha 7 7", b"gamma x 12 12 12", b"ALPHAbeta 3 3" + b" " * 40, b"63 63 xBeta"]
    whole = rules.rule_set(*texts).pack
    for d in data:
        alone = [k for k, yes in enumerate(whole.holds(d)) if yes]
        assert [k for k, _ in found.pack.scan(d)] == alone
    looked, before = [], matcher.Pattern.exists
    matcher.Pattern.exists = lambda self, *a: looked.append(id(self)) or before(self, *a)
    try:
        found.pack.holding(b"alpha Beta gamma x")
    finally:
        matcher.Pattern.exists = before
    assert len(looked) == len(set(looked)) and len(found.pack.alike) == 1 and not found.pack.always
    files = spark.createDataFrame([(str(i), d.decode()) for i, d in enumerate([*data, data[1]])], "path string, text string")
    expected = {(r.rule, r.n) for r in rules.matches(files, found).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert expected and {(r.rule, r.files) for r in rules.hit_counts(files, found).collect()} == expected


def test_large_tables_of_rules_are_counted_whole(spark, monkeypatch):
    """a table of rules over the bytes of a set is dealt to tasks, and gives what the set gives."""
    texts = [f'rule r{i} {{ strings: $a = "w{i % 7}" nocase $n = "{i}" fullword condition: $a and filesize < 9 or #n > 1 }}' for i in range(60)]
    texts.append('rule y { strings: $a = "w3" condition: $a } rule z { condition: not y }')
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(["W1", "w3 w5", "w3 w5", "12 12 59 59", "", None, "w6 12 and 12"])], "path string, text string")
    table = spark.createDataFrame([(t,) for t in texts], "body string")
    expected = {(r.rule, r.files) for r in rules.hit_counts(files, rules.rule_set(*texts)).collect()}
    for name, n in (("MOST_BYTES", 2000), ("RULE_BYTES", 1500), ("FILE_BYTES", 20)):
        monkeypatch.setattr(rules, name, n)
    counted = [tuple(r) for r in rules.hit_counts_of(files, table).collect()]
    assert len(counted) == len(expected) > 10 and set(counted) == expected
    for bad in (texts[0].replace("12", "13") + " ", "rule g { condition: z }", "global rule g { condition: true }"):
        with pytest.raises(Exception, match="declared twice|at most"):
            rules.hit_counts_of(files, table.union(spark.createDataFrame([(bad,)], "body string"))).collect()
    assert rules.hit_counts_of(files.limit(0), table).collect() == []
