from quarrylens.llm.handmade import classify_files, header_lines, line_keys, rule_class, vendor_package

WORDS = [a + b for a in ("red", "tall", "wide", "cold", "late") for b in ("Fox", "Lamp", "Road", "Bird", "Stone", "Cup")]
LIB = "\n".join(f"export function {w}(value, other) {{ return value * {i * 37} + other.{w}Field; }}" for i, w in enumerate(WORDS))
HAND = "import { a } from './a';\n\nexport function run(input) {\n  const total = input.map((x) => x.size);\n  if (!total.length) {\n    return null;\n  }\n  return total;\n}\n"


def test_rules():
    generated = ["// Code generated by gen 1.2. DO NOT EDIT.\n" + HAND, "/*\n * <auto-generated/>\n */\n" + HAND, "// Automatisch erzeugt aus a.xsd - nicht bearbeiten\n" + HAND,
                 'package a;\n@Generated("gen")\npublic final class A { int x; }', "// source: a.proto  (compiler gen)\n" + HAND]
    assert [rule_class("a.js", t) for t in generated] == ["generated"] * 5
    minified = "!function(e){e.m=4752}(this);" + "function ab1(e,t){return e&&t?e.n(t,2481):void 0}var c=[1,2];" * 20
    assert rule_class("a.js", minified) == "minified" and rule_class("a.js", HAND + "//# sourceMappingURL=a.js.map") == "minified"
    data = ["export default [\n" + "\n".join(f"[-{i}.123, {i}.5, {i}]," for i in range(60)) + "\n];", 'module.exports = "' + "aB3//x+9" * 100 + '";',
            "const rows = [" + ",".join('{"id":%d,"k":"ab","v":%d}' % (i, i * 7) for i in range(60)) + "];\nexport default rows;",
            "class T {\n static final int[] T = {\n" + "0x12, 0x34, 0xff,\n" * 60 + "};\n}"]
    assert [rule_class("a.ts", t) for t in data] == ["data"] * 4
    series = "\n".join(f"export const state{i} = {{ id: {i}, next: [{i * 7 % 5}] }};\nexport function step{i}(c) {{ return c === {i * 3} ? 1 : -1; }}" for i in range(12))
    assert rule_class("gen/a.js", series) == rule_class("a.js", series) == "generated"
    licence = "/*\n" + "\n".join(f" * Term {WORDS[i % len(WORDS)]} of the licence text." for i in range(45)) + "\n */\n"
    assert rule_class("a.js", licence + "// Code generated by gen 1.2. DO NOT EDIT.\n" + HAND) == "generated"


def test_hand_written_lookalikes():
    talk = [HAND + "// the code generator reads this list\n", "import x;\n// ids are generated by the database; do not edit them in the form\n" + HAND,
            HAND.replace("const total", "// minified output is checked later\nconst total"), "", "   \n", HAND * 400]
    assert [rule_class("src/vendor/VendorService.js", t) for t in talk] == [None] * len(talk)
    assert rule_class("src/generated/IdGenerator.js", HAND) is None and rule_class("distribution/external-orders/index.js", HAND) is None
    assert rule_class("a.ts", 'const names = ["coupon", "calendar", "recipe", "batch", "queue", "bundle", "payout", "claim"];\n' + HAND) is None
    assert rule_class("a.ts", '{\n  "a": {"b": 12, "c": 34},\n  "d": [1, 2, 3]\n}') is None
    assert header_lines("// a\n/* b\n c */\nimport x;\n// d\nlet y;\n// e") == ["// a", "/* b", "c */", "// d"]


def test_hand_written_files_with_borrowed_words():
    heads = ["// do not change this without asking the payments team\n", "/* Copyright. Do not modify. */\n", "/** @license MIT */\n", "/* (c) Acme authors, see LICENSE */\n"]
    assert [rule_class("src/a.js", h + HAND) for h in heads] == [None] * len(heads)
    assert rule_class("src/levels.js", "\n".join(f"export const level{i} = build({i});" for i in range(14))) is None
    assert rule_class("src/api-1.2.js", HAND) is None and rule_class("external/auth/index.js", HAND) is None
    assert [vendor_package(p) for p in ("external/auth/index.js", "a\\deps\\lib\\src\\x.js", "deps/x.js", "src/external-x/y.js", None)] == ["auth", "lib", "", None, None]


def test_other_files_of_a_copied_package(spark):
    rows = [("a1", "r1", "deps/lib/src/core.js", LIB), ("a2", "r2", "third_party/lib/core.js", LIB), ("b1", "r1", "deps/lib/src/extra.js", HAND),
            ("c1", "r3", "deps/own/src/extra.js", HAND), ("d1", "r3", "src/lib/extra.js", HAND)]
    df = spark.createDataFrame(rows, "file_id string, repository_id string, path string, content string")
    got = {r["file_id"]: r["kind"] for r in classify_files(df).collect()}
    assert got == {"a1": "vendored", "a2": "vendored", "b1": "vendored", "c1": None, "d1": None}


def test_line_keys_ignore_white_space():
    assert line_keys(LIB) == line_keys(LIB.replace("\n", "\r\n\n  ")) and len(line_keys(LIB)) == 29
    assert line_keys("a\nb\n") == []


def test_copies_across_repositories(spark):
    edited = LIB.replace("value * 37 ", "value * 38 ").replace("other.tallRoadField;", "other.tallRoadField || 1;")
    own = "\n".join(f"export const {w}Own = load{w}(\"thing {w}\", {i * 13});" for i, w in enumerate(WORDS))
    rows = [("copy1", "r1", "src/util/core.js", LIB), ("copy2", "r2", "lib/x.js", LIB), ("edited", "r3", "web/y.js", edited + "\nexport const more = 1;\n"),
            ("own1", "r1", "src/own.js", own), ("own2", "r1", "src/again.js", own), ("hand1", "r1", "a.js", HAND), ("hand2", "r2", "b.js", HAND), ("none", None, None, None)]
    df = spark.createDataFrame(rows, "file_id string, repository_id string, path string, content string").na.fill("", ["content"])
    got = {r["file_id"]: r["kind"] for r in classify_files(df).collect()}
    # hand1 and hand2 share too few lines to count as copies; own files repeat inside one repository only
    assert got == {"copy1": "vendored", "copy2": "vendored", "edited": "vendored", "own1": None, "own2": None, "hand1": None, "hand2": None, "none": None}
    assert classify_files(df.limit(0)).count() == 0


def test_hot_library(spark):
    rows = [(f"f{i}", f"r{i}", "x.js", LIB if i % 2 else LIB + f"\nexport const tail{i} = compute({i}, {i + 1});") for i in range(60)]
    df = spark.createDataFrame(rows, "file_id string, repository_id string, path string, content string")
    assert classify_files(df).filter("kind = 'vendored'").count() == 60


def test_copies_of_several_versions(spark):
    """An edited copy whose keys are shared by thirds with three versions: the class most voted for holds less than half."""
    def part(name, n):
        names = [f"{name}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(n)]
        return [f"export function {w}(value, other) {{ return value * {i * 37} + other.{w}Field; }}" for i, w in enumerate(names)]

    first, second, third = part("red", 40), part("cold", 30), part("late", 33)
    texts = {"v1": first + part("one", 30), "v3": third + part("three", 30), "v2": first + second + third, "edited": first + second + third + part("tail", 5)}
    # more classes hold the keys of v1 and v3, so that these classes are the least and greatest of more keys
    rows = [(k, f"r-{k}", "src/x.js", "\n".join(t)) for k, t in texts.items()]
    rows += [(f"{k}-{i}", f"r-{k}-{i}", "src/x.js", "\n".join(texts[k] + part(f"own{chr(97 + i // 26)}{chr(97 + i % 26)}x", 40))) for i in range(40) for k in ("v1", "v3")]
    got = {r["file_id"]: (r["kind"], r["containment"]) for r in classify_files(spark.createDataFrame(
        rows, "file_id string, repository_id string, path string, content string")).collect()}
    assert got["edited"][0] == got["v2"][0] == "vendored" and got["edited"][1] > 0.9


def test_marks_after_a_long_licence():
    terms = "".join(f" * term {w} of the licence\n" for w in WORDS * 20)
    assert rule_class("a.js", "/*\n" + terms + " * Code generated by gen 1.2. DO NOT EDIT.\n */\n" + HAND) == "generated"
    assert rule_class("a.js", "/*\n" + terms + " * @license lib 1.2.3\n */\n" + HAND) is None  # a licence alone makes no copy
    assert rule_class("a.js", "/*\n" + terms + " */\n" + HAND) is None
