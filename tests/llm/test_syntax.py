import pytest

from quarrylens.llm.broken_files import broken_rates, check_syntax
from quarrylens.llm.files import file_contents
from quarrylens.llm.syntax.check import extension, syntax_error
from quarrylens.llm.syntax.gll import Grammar

JAVA = '''package a.b;
import java.util.*;
import static java.lang.Math.max;
@Anno(value = "x", n = {1, 2}) @Deprecated
public sealed abstract class Foo<T extends Comparable<T> & Runnable> extends Base<List<Map<String, int[]>>> implements A, B permits C {
    private static final int X = 1 >>> 2, Y[] = {1, 2,};
    static { System.out.println('\\''); }
    public Foo() { this(1); }
    record P(int a, String... b) implements A { P { if (a < 0) throw new IllegalArgumentException(); } static int z; }
    enum E { A, B(1) { void f() {} }, ; int x; }
    @interface I { int value() default 3; String[] names() default {}; }
    interface J { default <R> R f(R r) { return r; } private void g() {} }
    <R> R m(final T t, int... xs) throws Exception, Error {
        int[][] a = new int[3][], b = {{1}, {2}};
        List<String> l = new ArrayList<>() {{ add("x"); }};
        Function<Integer, Integer> f = x -> x + 1, g = (Integer y) -> { return y; };
        Runnable r = (Runnable & java.io.Serializable) () -> {};
        for (int i = 0, n = 3; i < n; i++, n--) continue;
        outer: for (var e : l) { if (e == null) break outer; else continue outer; }
        String s = switch (t.k()) { case 1, 2 -> "a"; case 3 -> { yield "b"; } default -> throw new Error(); };
        switch (s) { case "x": case "y": foo(); break; default: }
        if (o instanceof String str && str.length() > 2) { l.<String>stream().map(String::valueOf).map(int[]::new); }
        try (var in = open(); in) { a(); } catch (A | B e) { } finally { }
        String t2 = """
            text " block \\""" end
            """;
        synchronized (this) { i = j = k >>= 2; x[0]++; ++y; }
        do { assert a > b : "m"; } while (a < b);
        return (T) (Object) (a < b ? c : d -> e);
    }
}
'''
JS = r'''#!/usr/bin/env node
import d, { a as b, default as c } from "./x.js"; import * as ns from 'y'; import "z";
export * from "q"; export { b as bb, c }; export default class extends Foo {}
const { a, b: { c2 = 1, ...r }, [k]: z } = o, [x,, y = 2, ...w] = arr;
let re = /[/\]"'`]+/gi, t = `a${`b${1 + `c`}`}d`, n = 1_000n + .5e-3 + 0xff
async function* gen(a = 1, { b }, ...c) { for await (const x of y) yield* x; await z }
label: for (var i = 0, j; i < 3; i++) { if (i) continue label; else break }
for (const k in o) ; for (x.y of z) {}
class A extends (B, C) { #p = 1; static s; static { init() } get v() { return this.#p } set v(x) {} async *m() {} [k]() {} 'q'() {} static async = 1 }
const f = async (a, { b }, [c]) => ({ a, b, ...c }), g = x => y => x ** y, h = async x => await x
a?.b?.[c]?.(d) ?? e; a ||= b; new.target; new Foo; new a.b.C(1).d()
if (a) b
else c
do x++; while (x < 5) y()
switch (x) { case 1: case 2: { break } default: z() }
try { a() } catch { b() } finally { c() }
var o = { get a() { return 1 }, set a(v) {}, async b() {}, *c() {}, [d]: 1, 'e': 2, 3: 4, f, g, ...h, async, get, if: 1 }
x = a ? b : c ? d : e
return_: { } delete a.b, void 0, typeof x
export const q = import("m"), meta = import.meta.url
'''
TS = '''import type { A } from "a"; import { type B, c } from "b"; import fs = require("fs");
abstract class Foo<T extends keyof X = any> extends Bar<T>.Baz implements I<T>, J {
  private readonly x?: number = 1; static y!: string; declare z: T; [key: string]: unknown;
  constructor(private a: string, public readonly b?: number, ...rest: any[]) { super() }
  abstract m(): void; get v(): number { return this.x! } async f<U>(this: Foo<U>, a?: U): Promise<U[]> { return [] }
  @dec({ a: 1 }) method(@inject() p: P) {}
}
interface I<T> extends A<T>, B { (a: number): string; new (a: number): I<T>; readonly [k: string]: any; m?(): void; get x(): number; p: T | null, q?: [a: number, b?: string, ...c: T[]] }
type M<T> = { readonly [K in keyof T as `x${K & string}`]-?: T[K] } | (A & B)["c"][] | typeof import("x") | ((a: number, b?: string) => asserts a is string);
type C<T> = T extends (infer U extends string)[] ? U : T extends { a: infer V } ? V : never;
type Fn = abstract new <T>(x: T) => T; type L = | 1 | -2 | "s" | true | `t${number}`;
enum E { A = 1 << 2, B, C = "x".length } declare const enum F { X } const enum G { Y }
declare module "m" { export function f(a: number): void; export default x } declare global { interface Window { a: 1 } } namespace N.M { export const x = 1 }
function over(a: string): void; function over(a: number): void; function over(a: any) {}
function isS(x: unknown): x is string { return typeof x === "string" } function ass(x: any): asserts x {}
let v = <any>foo, w = foo as unknown as Bar<Baz<Qux>>, u = f<string>(1), s = { a: 1 } satisfies T, k = a as const;
const arrow = async <T,>(x: T): Promise<T> => x, h = (a?: number, { b }: { b: string } = c): void => {}, cond = a ? (b) : (c);
let x = a < b && c > (d), y = new Map<string, Array<Array<number>>>(), z = obj!.a![0]; export = foo
'''
JSX = '''export const A = ({ a, ...p }) => (<><B.C x="1" y={a} {...p} z-a:b='q' w=<i/> >text &amp; more {a && <b>{x}</b>} {/* c */} </B.C><br/></>);
const less = a < b; function f() { return <div onClick={() => { if (a > b) x(`${<i>t</i>}`) }}>it's {a} / "fine" // yes</div> }
'''


@pytest.mark.parametrize(("path", "text"), [
    ("a/Foo.java", JAVA), ("m/module-info.java", "open module a.b { requires transitive c; exports d to e, f; uses g; provides h with i; }"),
    ("a.js", JS), ("a.mjs", "not checked ("), ("a.ts", TS), ("a.jsx", JSX), ("a.tsx", JSX),
    ("a.js", ""), ("A.java", "// only\n/* comments */"), ("a.ts", "﻿let a = 1\n"), ("a.js", "\r\n\t"), ("a.JAVA", "class A {}"), ("A.java", "\n;;\nclass A {};"),
    ("x.js", 'const s = "<<<<<<< HEAD"; // >>>>>>> x\n'), ("A.java", 'class A { String s = "{ ( ["; char c = \'"\'; /* } */ }')])
def test_valid(path, text):
    assert syntax_error(path, text) is None


@pytest.mark.parametrize(("path", "text"), [
    ("A.java", "class A { void f() { int x = ; } }"), ("A.java", "class A { void f() { } "), ("A.java", "class A { void f( { } }"), ("A.java", "class A { int x = (4 + ; }"),
    ("A.java", "class A { String s = \"x; }"), ("A.java", "class A {\n<<<<<<< HEAD\nint a;\n=======\n}"), ("A.java", "def f(self):\n    return 1\n"), ("A.java", "class A { void f() { a + b; } }"),
    ("A.java", "class A { /* open }"), ("A.java", "{\"a\": 1}"), ("A.java", "class A { void f() { if (a &lt; b) { } } }"), ("A.java", "package a"), ("A.java", "class A { int 9x; }"),
    ("a.js", "const x: number = 1;"), ("a.js", "function f( { return 1 }"), ("a.js", "let a = <b/>;"), ("a.js", "const a;"), ("a.js", "a b"), ("a.js", "const t = `a${b`;"),
    ("a.js", "if (a) { b() "), ("a.js", "const a = [1, 2"), ("a.js", "class A { m() { } "), ("a.js", "1 | const a = 1;"), ("a.js", "var r = /a(/gg;"), ("a.js", "public class A { }"),
    ("a.js", "{ a: 1, b: 2 }"), ("a.js", "enum A { B }"), ("a.ts", "let x = <div>a</div>;"), ("a.ts", "interface { a: 1 }"), ("a.ts", "let x: = 1;"), ("a.ts", "public class A { int x; }"),
    ("a.jsx", "const a = <b>x</c>;"), ("a.jsx", "const a = <b>x;"), ("a.jsx", "const a = <b x=1/>;"), ("a.tsx", "<!DOCTYPE html>\n<html></html>"), ("a.tsx", "const a = <T>(x: T) => x;")])
def test_invalid(path, text):
    assert syntax_error(path, text) is not None


def test_every_truncation_of_a_class_is_rejected():
    text = "class A { int f(int a) { return a; } }"
    assert all(syntax_error("A.java", text[:n]) for n in range(6, len(text)))


def test_ambiguous_and_recursive_grammar():
    g = Grammar("S = E 'EOF' ; E = E 'plus' E | 'a' ;", {})
    tokens = lambda s: g.columns([(t, False) for t in [*s.split(), "EOF"]])
    assert g.accepts_tokens(tokens("a plus a plus a"), ["S"]) == -1
    assert g.accepts_tokens(tokens("a plus plus a"), ["S"]) == 2
    both = Grammar("S = 'a' 'EOF' ; T = 'b' 'EOF' ;", {})
    assert both.accepts_tokens(both.columns([("b", False), ("EOF", False)]), ["S", "T"]) == -1
    with pytest.raises(ValueError):
        Grammar("S = A 'EOF' ; A = 'x'? ;", {})


def test_extension():
    assert [extension(p) for p in ("a\\b.TSX", "x.y/z", None, "Makefile", ".js")] == [".tsx", "", "", "", ".js"]


def test_files_on_spark(spark):
    files = spark.createDataFrame(
        [("F1", "r", "a/A.java", "java", 1, None, None, "x"), ("f1", "r", "a/A.js", "js", 1, None, None, "x"), ("f2", "r", "b.js", None, None, None, None, "x"),
         ("f3", None, None, None, None, None, None, "x"), ("f4", "r", "c.js", None, None, None, None, "x")],
        "id string, repository_id string, path string, language string, size long, ingested_at timestamp_ntz, deleted_at timestamp_ntz, content string")
    texts = spark.createDataFrame([("f1 ", "let a = (", "q"), ("f2", None, "q"), ("f3", "((", "q"), ("zz", "((", "q"), (None, "((", "q"), ("f4", "ok()", "q")],
                                  "file_id string, content string, path string")
    got = {r["file_id"]: r["error"] is not None for r in check_syntax(file_contents(files, texts)).collect()}
    assert got == {"f1": True, "f2": False, "f3": False, "f4": False}
    rates = broken_rates(check_syntax(file_contents(files, texts)))
    assert {tuple(r) for r in rates.collect()} == {("r", "javascript", 3, 1, 0.333333), (None, "other", 1, 0, 0.0)}
    assert check_syntax(file_contents(files.limit(0), texts)).count() == 0


ARROWS = """const f = (a: T): string => "x", g = (n: number): boolean => n > 1, h = (): Foo => foo, k = (i): i is Foo => !!i;
class A { private on = (e: Event): string => { return `${e}`; }; static make = async (x?: number): Promise<A[]> => [new A()]; p = (q) => q as B; }
const t = a ? (b) : c, u = a ? (b): string => b : (c): D => c, v = x.map((y): y is Z => ok(y)).filter(z => z), w = async x => await x, id = async(1);
export type Fn = (a: number, ...rest: string[]) => (b: T) => void;
"""
VALID = [
    ("a.ts", ARROWS), ("a.tsx", ARROWS),
    ("a.js", "if (x) /re/.test(y)"), ("a.js", "while (next()) /[)]/g.exec(y);"), ("a.js", "const a = f(x) / 2 / 3"), ("a.js", "const b = 1; export { b as \"str\" }"),
    ("A.java", "class A { void f() { o.new Inner(); a.b.c.new D<>(1) {}; x = o.new E(); } }"),
    ("a.tsx", "const a = <Foo<string> x={1}/>, b = <Foo<A<B>, { c: () => void }>>t</Foo>;"),
    ("A.java", "class A { Object f() { return switch (k) { case A -> b -> c; case B, C -> { yield (x) -> x; } case D.E -> (int) (y); default -> a < b ? (c) : d; }; } }"),
    ("A.java", "class A { void f() { a.b.C<D>.E[] x = y, z[] = {}; int[] w; a.b[1].c(); i = a < b; label: for (;;) { break label; } } int m = 010, n = 0_7, o = 09.5; }"),
    ("a.js", "l: { break l }  for (;;) { if (a) break; else continue } switch (x) { case 1: break } function f() { while (1) { switch (y) { default: continue } } return\n1 }"),
    ("a.js", "[a, b] = [b, a]; ({ a, b: c.d } = e); (a) = 1; a[0].b++; new A().b = c; x = y ? z => 1 : (w) => 2; (-1) ** 2; 2 ** -1; (a ?? b) || c; a ?? (b && c)"),
    ("a.ts", "let a = b as C; (a as any).b = 1; a!.b = 2; const n = x! + y, m = <T,>(z: T) => z; abstract class Q { abstract r(): void }"),
]
INVALID = [
    ("a.js", "function f() { throw\nnew Error() }"), ("a.js", "a + b = c"), ("a.js", "f() = 1"), ("a.js", "x ?? y || z"), ("a.js", "x && y ?? z"), ("a.js", "-1 ** 2"),
    ("a.js", "function (){}"), ("a.js", "return 1"), ("a.js", "break;"), ("a.js", "if (a) { continue }"), ("a.js", "while (1) { function f() { break } }"), ("a.js", "a++ = 1"),
    ("A.java", "class A { int x = 09; }"), ("A.java", "class A { public public int x; }"), ("a.ts", "const f = (a: T): => 1;"), ("a.tsx", "const a = <Foo<string x={1}/>;"),
]


@pytest.mark.parametrize(("path", "text"), VALID)
def test_more_valid(path, text):
    assert syntax_error(path, text) is None


@pytest.mark.parametrize(("path", "text"), INVALID)
def test_more_invalid(path, text):
    assert syntax_error(path, text) is not None
