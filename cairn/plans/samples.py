"""Source samples by language, with all chunks and edges that must come out of them.

Chunks: (type, name, class, first line, last line).  Edges: (type, symbol, file hint, line of the chunk that they start in).
"""

SAMPLES = {
    "typescript": (
        'import { shown, x as y } from "./format";\nimport Emitter from "emitter";\n\n/** doc */\nexport class Depot extends Emitter {\n  constructor(private readonly z: string) {\n    super();\n  }\n  async label(name: string): Promise<string> {\n    if (name) { return shown(name); }\n    return new Foo().bar();\n  }\n}\nexport function openDepot(): Depot {\n  return new Depot("a{b");\n}\nexport const add = (a: number, b: number) => {\n  return a + b;\n};\nexport interface User { name: string }\nexport type Alias = string | number;\nexport enum Color { Red, Green }\nexport const CONFIG = {\n  alpha: 1, beta: "a long enough constant for the limit",\n};\nnamespace NS { export const a = 1; }\n',
        [("import", None, None, 1, 2), ("function", "openDepot", None, 14, 16), ("function", "add", None, 17, 19), ("class", "Depot", None, 4, 13), ("method", "constructor", "Depot", 6, 8), ("method", "label", "Depot", 9, 12), ("interface", "User", None, 20, 20), ("type", "Alias", None, 21, 21), ("enum", "Color", None, 22, 22), ("namespace", "NS", None, 26, 26), ("const", "CONFIG", None, 23, 25)],
        [("IMPORTS", "./format", "./format", 1), ("IMPORTS", "emitter", "emitter", 1), ("EXTENDS", "Emitter", "emitter", 4), ("CALLS", "shown", None, 9), ("CALLS", "Foo", None, 9), ("CALLS", "bar", None, 9), ("CALLS", "Depot", None, 14)],
    ),
    "javascript": (
        'function* gen() { yield 1; }\nclass A extends B {\n  m() { return f(1); }\n}\n',
        [("function", "gen", None, 1, 1), ("class", "A", None, 2, 4), ("method", "m", "A", 3, 3)],
        [("EXTENDS", "B", None, 2), ("CALLS", "f", None, 3)],
    ),
    "python": (
        "import os\nfrom .x import y\nclass A(B):\n    def m(self):\n        return helper(1)\ndef f():\n    pass\ntype P = int\nLONG_CONSTANT = {'a': 1, 'b': 2, 'c': 3, 'dddddd': 4}\n",
        [("import", None, None, 1, 2), ("class", "A", None, 3, 5), ("function", "m", "A", 4, 5), ("function", "f", None, 6, 7), ("typealias", "P", None, 8, 8), ("const", "LONG_CONSTANT", None, 9, 9)],
        [("IMPORTS", "os", "os", 1), ("IMPORTS", ".x", ".x", 1), ("EXTENDS", "B", None, 3), ("CALLS", "helper", None, 4)],
    ),
    "go": (
        'package main\n\nimport "fmt"\n\n// Salute is short\nfunc Salute(name string) string {\n\treturn fmt.Sprintf("dear %s", name)\n}\n\ntype Depot struct {\n\tdb string\n}\n\ntype Shelf interface {\n\tEverything() []string\n}\n\nfunc (u *Depot) Fetch(id string) string {\n\treturn u.db\n}\n',
        [("import", None, None, 3, 3), ("function", "Salute", None, 5, 8), ("method", "Fetch", "Depot", 18, 20), ("struct", "Depot", None, 10, 12), ("interface", "Shelf", None, 14, 16)],
        [("IMPORTS", "fmt", "fmt", 3), ("CALLS", "Sprintf", None, 5)],
    ),
    "rust": (
        "use std::io;\npub struct P { x: i32 }\nenum E { A }\nimpl P {\n    pub fn new<'a>(x: &'a str) -> Self { helper(x) }\n}\ntrait T {\n    fn a(&self);\n}\nmod m {}\nmacro_rules! mac { () => {} }\ntype A = i32;\nfn helper(x: &str) -> P { P { x: 1 } }\n",
        [("import", None, None, 1, 1), ("struct", "P", None, 2, 2), ("enum", "E", None, 3, 3), ("trait", "T", None, 7, 9), ("class", "P", None, 4, 6), ("module", "m", None, 10, 10), ("macro", "mac", None, 11, 11), ("typealias", "A", None, 12, 12), ("function", "new", "P", 5, 5), ("function", "a", "T", 8, 8), ("function", "helper", None, 13, 13)],
        [("IMPORTS", "std::io", "std::io", 1), ("CALLS", "helper", None, 5)],
    ),
    "java": (
        'package a;\nimport java.util.List;\n\npublic class Foo extends Bar implements Baz, Qux<String> {\n    private int x = 1;\n    @Override\n    public List<String> get(int a) {\n        if (a > 1) { return list(a); }\n        return null;\n    }\n    Foo() { super(); }\n}\ninterface I { }\nenum E { A, B }\nrecord R(int a) {}\n',
        [("import", None, None, 2, 2), ("class", "Foo", None, 4, 12), ("interface", "I", None, 13, 13), ("enum", "E", None, 14, 14), ("record", "R", None, 15, 15), ("method", "get", "Foo", 6, 10), ("method", "Foo", "Foo", 11, 11)],
        [("IMPORTS", "java.util.List", "java.util.List", 2), ("EXTENDS", "Bar", None, 4), ("IMPLEMENTS", "Baz", None, 4), ("IMPLEMENTS", "Qux", None, 4), ("CALLS", "list", None, 6)],
    ),
    "c": (
        '#include <stdio.h>\n#define MAX_LENGTH_OF_X 100\ntypedef struct Foo { int a; } Foo;\nstruct Bar { int b; };\nenum E { A };\nstatic int add(int a, int b) {\n  return helper(a);\n}\n',
        [("import", None, None, 1, 1), ("struct", "Foo", None, 3, 3), ("struct", "Bar", None, 4, 4), ("enum", "E", None, 5, 5), ("typealias", "Foo", None, 3, 3), ("macro", "MAX_LENGTH_OF_X", None, 2, 2), ("function", "add", None, 6, 8)],
        [("IMPORTS", "stdio.h", "stdio.h", 1), ("CALLS", "helper", None, 6)],
    ),
    "cpp": (
        '#include <vector>\nnamespace ns {\nclass A : public B {\n public:\n  int get(int x) { return f(x); }\n};\nstruct S { int a; };\nenum class E { X };\nusing V = int;\n}\nint main() { return 0; }\n',
        [("import", None, None, 1, 1), ("class", "A", None, 3, 6), ("struct", "S", None, 7, 7), ("enum", "E", None, 8, 8), ("namespace", "ns", None, 2, 10), ("typealias", "V", None, 9, 9), ("method", "get", "A", 5, 5), ("function", "main", None, 11, 11)],
        [("IMPORTS", "vector", "vector", 1), ("EXTENDS", "B", None, 3), ("CALLS", "f", None, 5)],
    ),
    "csharp": (
        'using System;\nnamespace N {\npublic class A : B, IC {\n    public int P { get; set; }\n    public event Action Done;\n    public int M(int x) { return F(x); }\n}\npublic record R(int X);\npublic struct S { }\npublic interface I { }\npublic enum E { X }\npublic delegate void D(int x);\n}\n',
        [("import", None, None, 1, 1), ("class", "A", None, 3, 7), ("record", "R", None, 8, 8), ("struct", "S", None, 9, 9), ("interface", "I", None, 10, 10), ("enum", "E", None, 11, 11), ("typealias", "D", None, 12, 12), ("method", "M", "A", 6, 6), ("property", "P", "A", 4, 4), ("event", "Done", "A", 5, 5)],
        [("IMPORTS", "System", "System", 1), ("EXTENDS", "B", None, 3), ("EXTENDS", "IC", None, 3), ("CALLS", "F", None, 6)],
    ),
    "swift": (
        'import Foundation\nclass A: B {\n    func m() { f(1) }\n}\nstruct S {}\nenum E { case a }\nactor Act {}\nextension A {}\nprotocol P {}\ntypealias T = Int\nfunc top() -> Int { return 1 }\n',
        [("import", None, None, 1, 1), ("class", "A", None, 2, 4), ("struct", "S", None, 5, 5), ("enum", "E", None, 6, 6), ("actor", "Act", None, 7, 7), ("extension", "A", None, 8, 8), ("protocol", "P", None, 9, 9), ("typealias", "T", None, 10, 10), ("method", "m", "A", 3, 3), ("function", "top", None, 11, 11)],
        [("IMPORTS", "Foundation", "Foundation", 1), ("EXTENDS", "B", None, 2), ("CALLS", "f", None, 3)],
    ),
    "kotlin": (
        'import a.b\ndata class P(val x: Int) : Base(x), Iface {\n  fun area(): Int = x * 2\n  fun two() { call(1) }\n}\nenum class C { A }\ninterface I\nobject O { fun z() {} }\ntypealias T = Int\nfun top(a: Int) = a\n',
        [("import", None, None, 1, 1), ("class", "P", None, 2, 5), ("interface", "I", None, 7, 7), ("enum", "C", None, 6, 6), ("object", "O", None, 8, 8), ("typealias", "T", None, 9, 9), ("method", "area", "P", 3, 3), ("method", "two", "P", 4, 4), ("function", "top", None, 10, 10)],
        [("IMPORTS", "a.b", "a.b", 1), ("EXTENDS", "Base", None, 2), ("IMPLEMENTS", "Iface", None, 2), ("CALLS", "call", None, 4)],
    ),
    "ruby": (
        "require 'json'\nclass User < Base\n  has_many :posts\n  def name\n    if x\n      foo(1)\n    end\n  end\nend\ndef top\n  bar\nend\n",
        [("import", None, None, 1, 1), ("class", "User", None, 2, 9), ("method", "name", "User", 4, 8), ("function", "top", None, 10, 12), ("dsl_call", "has_many", "User", 3, 3)],
        [("IMPORTS", "json", "json", 1), ("EXTENDS", "Base", None, 2), ("CALLS", "foo", None, 4)],
    ),
    "php": (
        '<?php\nuse App\\Models\\User;\nfunction top($x) { return f($x); }\nclass A extends B implements C {\n    private string $name;\n    public function m() { return top(1); }\n}\ninterface I {}\ntrait T {}\nenum E {}\n',
        [("import", None, None, 2, 2), ("function", "top", None, 3, 3), ("class", "A", None, 4, 7), ("interface", "I", None, 8, 8), ("trait", "T", None, 9, 9), ("enum", "E", None, 10, 10), ("property", "name", "A", 5, 5), ("method", "m", "A", 6, 6)],
        [("IMPORTS", "App\\Models\\User", "App\\Models\\User", 2), ("EXTENDS", "B", None, 4), ("IMPLEMENTS", "C", None, 4), ("CALLS", "f", None, 3), ("CALLS", "top", None, 6)],
    ),
    "bash": (
        'source ./lib.sh\nDEFAULT_DIRECTORY="/usr/local/share/something/else"\nfoo() {\n  bar 1\n}\nfunction baz {\n  foo\n}\n',
        [("import", None, None, 1, 1), ("function", "foo", None, 3, 5), ("function", "baz", None, 6, 8), ("const", "DEFAULT_DIRECTORY", None, 2, 2)],
        [("IMPORTS", "./lib.sh", "./lib.sh", 1), ("CALLS", "source", None, 1), ("CALLS", "bar", None, 3), ("CALLS", "foo", None, 6)],
    ),
    "scala": (
        'import a.b\nclass A extends B {\n  def m(): Int = { f(1) }\n}\ncase class R(x: Int)\nobject O {}\ntrait T\nenum E { case X }\ntype Y = Int\ngiven ord: Int = 1\ndef top() = 1\n',
        [("import", None, None, 1, 1), ("class", "A", None, 2, 4), ("record", "R", None, 5, 5), ("object", "O", None, 6, 6), ("trait", "T", None, 7, 7), ("enum", "E", None, 8, 8), ("typealias", "Y", None, 9, 9), ("instance", "ord", None, 10, 10), ("method", "m", "A", 3, 3), ("function", "top", None, 11, 11)],
        [("IMPORTS", "a.b", "a.b", 1), ("EXTENDS", "B", None, 2), ("CALLS", "f", None, 3)],
    ),
    "lua": (
        'local m = require("x")\nfunction M.foo(a)\n  if a then\n    return bar(a)\n  end\nend\nlocal function baz() end\n',
        [("import", None, None, 1, 1), ("function", "M.foo", None, 2, 6), ("function", "baz", None, 7, 7)],
        [("IMPORTS", "x", "x", 1), ("CALLS", "bar", None, 2)],
    ),
    "r": (
        'library("dplyr")\nadd <- function(x, y) {\n  helper(x)\n}\nsetClass("P", representation(x = "numeric"))\nsetGeneric("area", function(s) standardGeneric("area"))\nsetMethod("area", "P", function(s) 1)\n',
        [("import", None, None, 1, 1), ("function", "add", None, 2, 4), ("class", "P", None, 5, 5), ("method", "area", None, 7, 7), ("function", "area", None, 6, 6)],
        [("IMPORTS", "dplyr", "dplyr", 1), ("CALLS", "library", None, 1), ("CALLS", "helper", None, 2), ("CALLS", "setClass", None, 5), ("CALLS", "representation", None, 5), ("CALLS", "setGeneric", None, 6), ("CALLS", "standardGeneric", None, 6), ("CALLS", "setMethod", None, 7)],
    ),
    "dart": (
        "import 'dart:io';\nclass A extends B {\n  int m() { return 1; }\n}\nmixin M {}\nextension X on A {}\nenum E { a }\ntypedef F = int Function();\nvoid main() {}\n",
        [("import", None, None, 1, 1), ("class", "A", None, 2, 4), ("mixin", "M", None, 5, 5), ("extension", "X", None, 6, 6), ("enum", "E", None, 7, 7), ("typealias", "F", None, 8, 8), ("method", "m", "A", 3, 3), ("function", "main", None, 9, 9)],
        [("IMPORTS", "dart:io", "dart:io", 1), ("EXTENDS", "B", None, 2)],
    ),
    "haskell": (
        'module A where\nimport Data.List\ndata T = A | B\n  deriving Show\nnewtype N = N Int\ntype S = String\nfoo :: Int -> Int\nfoo x = bar x\nfoo y = 2\nclass C a where\n  m :: a\ninstance C T where\n  m = A\n',
        [("import", None, None, 2, 2), ("function", "foo", None, 8, 8), ("type", "T", None, 3, 4), ("class", "C", None, 10, 11), ("instance", "C T", None, 12, 13), ("newtype", "N", None, 5, 5), ("typealias", "S", None, 6, 6)],
        [("IMPORTS", "Data.List", "Data.List", 2), ("CALLS", "bar", None, 8)],
    ),
    "elixir": (
        'defmodule A.B do\n  alias X.Y\n  def foo(x) do\n    bar(x)\n  end\n  defmacro mac(x), do: x\nend\ndefprotocol P do\n  def q(x)\nend\ndefimpl P, for: Integer do\n  def q(x), do: x\nend\n',
        [("import", None, None, 2, 2), ("module", "A.B", None, 1, 7), ("protocol", "P", None, 8, 10), ("instance", "P", None, 11, 13), ("method", "foo", "A.B", 3, 5), ("method", "q", "P", 9, 9), ("method", "q", "P", 12, 12), ("macro", "mac", "A.B", 6, 6)],
        [("IMPORTS", "X.Y", "X.Y", 2), ("CALLS", "bar", None, 3)],
    ),
    "clojure": (
        '(ns a.b (:require [c.d :as d]))\n(defn foo [x] (bar x))\n(defmacro m [x] x)\n(defprotocol P (q [x]))\n(defrecord R [x])\n(defmulti mm :kind)\n(def long-constant-name {:a 1 :b 2 :c 3 :d 4})\n',
        [("import", None, None, 1, 1), ("function", "foo", None, 2, 2), ("macro", "m", None, 3, 3), ("protocol", "P", None, 4, 4), ("record", "R", None, 5, 5), ("method", "mm", None, 6, 6), ("const", "long-constant-name", None, 7, 7)],
        [("IMPORTS", "c.d", "c.d", 1), ("CALLS", "bar", None, 2), ("CALLS", "q", None, 4)],
    ),
    "groovy": (
        'import a.B\nclass A {\n  def m(x) { f(x) }\n}\ndef closure = { it + 1 }\n',
        [("import", None, None, 1, 1), ("class", "A", None, 2, 4), ("method", "m", "A", 3, 3), ("function", "closure", None, 5, 5)],
        [("IMPORTS", "a.B", "a.B", 1), ("CALLS", "f", None, 3)],
    ),
    "perl": (
        "use Moose;\nhas 'name' => (is => 'rw');\nsub greet {\n  return 1;\n}\n",
        [("import", None, None, 1, 1), ("function", "greet", None, 3, 5), ("property", "name", None, 2, 2)],
        [("IMPORTS", "Moose", "Moose", 1)],
    ),
    "powershell": (
        'using module Foo\nparam(\n  [string]$Name\n)\nclass A {\n  [int] Run() {\n    return 1\n  }\n}\nfunction Get-Thing {\n  Invoke-Other 1\n}\n',
        [("import", None, None, 1, 1), ("class", "A", None, 5, 9), ("function", "Get-Thing", None, 10, 12), ("method", "Run", "A", 6, 8), ("param_block", "param", None, 2, 4)],
        [("IMPORTS", "Foo", "Foo", 1), ("CALLS", "Invoke-Other", None, 10)],
    ),
    "matlab": (
        'classdef A < handle\n  properties\n    x\n  end\n  methods\n    function r = go(obj)\n      r = f(1);\n    end\n  end\nend\n',
        [("class", "A", None, 1, 10), ("method", "go", "A", 6, 8), ("property", "properties", "A", 2, 4)],
        [("CALLS", "f", None, 6)],
    ),
    "zig": (
        'const std = @import("std");\nconst P = struct {\n    x: i32,\n    fn get(self: P) i32 { return self.x; }\n};\nconst E = enum { a, b };\npub fn main() void {}\ntest "adds" { }\n',
        [("import", None, None, 1, 1), ("struct", "P", None, 2, 5), ("enum", "E", None, 6, 6), ("test", "adds", None, 8, 8), ("method", "get", "P", 4, 4), ("function", "main", None, 7, 7)],
        [("IMPORTS", "std", "std", 1)],
    ),
    "solidity": (
        'import "./B.sol";\ncontract A is B {\n    uint256 public constant TOTAL_SUPPLY = 1000000;\n    event Sent(address to);\n    error Bad();\n    modifier only() { _; }\n    struct S { uint a; }\n    enum E { X }\n    function send(uint x) public { f(x); }\n}\ninterface I {}\nlibrary L {}\n',
        [("import", None, None, 1, 1), ("class", "A", None, 2, 10), ("interface", "I", None, 11, 11), ("event", "Sent", "A", 4, 4), ("modifier", "only", "A", 6, 6), ("library", "L", None, 12, 12), ("struct", "S", "A", 7, 7), ("enum", "E", "A", 8, 8), ("error", "Bad", "A", 5, 5), ("state_variable", "TOTAL_SUPPLY", "A", 3, 3), ("method", "send", "A", 9, 9)],
        [("IMPORTS", "./B.sol", "./B.sol", 1), ("EXTENDS", "B", None, 2), ("CALLS", "f", None, 9)],
    ),
    "julia": (
        'module M\nusing LinearAlgebra\nfunction foo(x)\n  if x\n    bar(x)\n  end\nend\nstruct P\n  x\nend\nmacro m(x)\n  x\nend\nabstract type T end\nend\n',
        [("import", None, None, 2, 2), ("module", "M", None, 1, 14), ("method", "foo", "M", 3, 7), ("struct", "P", None, 8, 10), ("macro", "m", "M", 11, 13), ("type", "T", "M", 14, 14)],
        [("IMPORTS", "LinearAlgebra", "LinearAlgebra", 2), ("CALLS", "bar", None, 3)],
    ),
    "ocaml": (
        'open Printf\nmodule type S = sig\n  val x : int\nend\nmodule M = struct\n  let y = 1\nend\nmodule F (X : S) = struct\nend\nlet add a b = a + b\ntype t = A | B\n',
        [("import", None, None, 1, 1), ("module_type", "S", None, 2, 3), ("functor", "F", None, 8, 8), ("module", "M", None, 5, 6), ("function", "y", "M", 6, 6), ("function", "add", None, 10, 10), ("type", "t", None, 11, 11)],
        [("IMPORTS", "Printf", "Printf", 1)],
    ),
    "erlang": (
        '-module(m).\n-export([f/1]).\n-record(person, {name}).\nf(X) ->\n  g(X).\n',
        [("import", None, None, 1, 2), ("record", "person", None, 3, 3), ("function", "f", None, 4, 5)],
        [("IMPORTS", "m", "m", 1), ("CALLS", "g", None, 4)],
    ),
    "objc": (
        '#import <Foundation/Foundation.h>\n@interface A : NSObject\n@property int x;\n- (void)run;\n@end\n@implementation A\n- (void)run {\n  f(1);\n}\n@end\n@interface A (Cat)\n@end\n@protocol P\n@end\n',
        [("import", None, None, 1, 1), ("class", "A", None, 2, 5), ("protocol", "P", None, 13, 14), ("extension", "A", None, 11, 12), ("property", "x", "A", 3, 3), ("method", "run", "A", 4, 4), ("method", "run", "A", 7, 9)],
        [("IMPORTS", "Foundation/Foundation.h", "Foundation/Foundation.h", 1), ("CALLS", "f", None, 7)],
    ),
    "sql": (
        '-- users\nCREATE TABLE users (id int);\nCREATE VIEW v AS SELECT 1;\nCREATE FUNCTION f() RETURNS int AS $$ select 1; $$;\nSELECT * FROM users;\nINSERT INTO users VALUES (1);\n',
        [("struct", "CREATE TABLE users", None, 1, 2), ("type", "CREATE VIEW v", None, 3, 3), ("function", "CREATE FUNCTION f", None, 4, 4), ("file", "SELECT", None, 5, 5), ("file", "INSERT", None, 6, 6)],
        [],
    ),
    "markdown": (
        'lost\n# Guide\ntext\n## Install\na\n### Config\nb\n## Usage\nc\n',
        [("section", "Guide", None, 2, 3), ("section", "Install", None, 4, 5), ("section", "Config", None, 6, 7), ("section", "Usage", None, 8, 10)],
        [],
    ),
    "css": (
        '.a { x: 1 }\n.b { y: 2 }\n@media print { .c { z: 3 } }\n.d {}\n',
        [("file", ".a", None, 1, 1), ("file", ".b", None, 2, 2), ("file", "@media print", None, 3, 3), ("file", ".d", None, 4, 4)],
        [],
    ),
    "scss": (
        '@mixin m($x) { a: 1 }\n$primary-color-long: #ff00ff00ff00;\n@media screen { .a { b: 1 } }\n.a {}\n.b {}\n.c {}\n.d {}\n',
        [("function", "m", None, 1, 1), ("const", "$primary-color-long", None, 2, 2), ("section", "@media screen", None, 3, 3), ("section", ".a", None, 4, 4), ("section", ".b", None, 5, 5), ("section", ".c", None, 6, 6), ("section", ".d", None, 7, 7)],
        [],
    ),
    "vue": (
        '<template>\n  <p/>\n</template>\n<script setup lang="ts">\nimport x from "./x";\nfunction go() { return x(); }\n</script>\n<style>\n.a {}\n</style>\n',
        [("section", "template", None, 1, 3), ("import", None, None, 5, 5), ("function", "go", None, 6, 6), ("section", "style", None, 8, 10)],
        [("IMPORTS", "./x", "./x", 1), ("CALLS", "x", None, 6)],
    ),
    "svelte": (
        '<script>\n  function go() { return f(); }\n</script>\n<h1>Hi</h1>\n<style>\n h1 {}\n</style>\n',
        [("function", "go", None, 2, 2), ("section", "style", None, 5, 7), ("section", "template", None, 4, 4)],
        [("CALLS", "f", None, 2)],
    ),
    "json": (
        "{\n" + ",\n".join(f'  "key{i}": {i}' for i in range(20)) + "\n}",
        [("file", f"key{i}", None, i + 2, i + 2 + (i == 19)) for i in range(20)],
        [],
    ),
    "yaml": (
        'a: 1\nb:\n  c: 2\nd: 3\n---\ne: 4\n',
        [("file", "a", None, 1, 1), ("file", "b", None, 2, 3), ("file", "d", None, 4, 4), ("file", "---", None, 5, 5), ("file", "e", None, 6, 7)],
        [],
    ),
    "toml": (
        'x = 1\n[a]\ny = 1\n[[b]]\n[c]\n[d.e]\n',
        [("file", "a", None, 2, 3), ("file", "b", None, 4, 4), ("file", "c", None, 5, 5), ("file", "d.e", None, 6, 7)],
        [],
    ),
    "xml": (
        '<r>\n<a/>\n<b>\n</b>\n<c/>\n<d/>\n</r>',
        [("file", "a", None, 2, 2), ("file", "b", None, 3, 4), ("file", "c", None, 5, 5), ("file", "d", None, 6, 6)],
        [],
    ),
    "html": (
        '<h1>a</h1>\n<p>b</p>\n<div>\n<p>c</p>\n</div>\n<hr>\n',
        [("file", "h1", None, 1, 1), ("file", "p", None, 2, 2), ("file", "div", None, 3, 5), ("file", "hr", None, 6, 6)],
        [],
    ),
}
