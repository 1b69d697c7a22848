"""Symbols of brace languages, checked by hand."""

from fathom.operators import nesting

JS = r"""// class Fake {
import x from "y";
const brace = "{", re = /[{}]\/{/g, t = `a ${ {b: `{`}.b } {`;
/* function gone() { */
export class Shop extends Base {
  constructor(a) {
    this.a = { b: 1 };
  }
  async find(q) {
    if (q) { return /}/.test(q); }
    const inner = (z) => {
      return z;
    };
    return list.map(function each(v) {
      return { v };
    });
  }
}
function outer(cb) {
  for (let i = 0; i < 3; i++) { cb(i); }
}
const arrow = async (p) => {
  return p;
};
arrow(() => { outer(); });
"""
GO = """package main

type Box struct {
\tn int
}

func (b *Box) Get(k string) (int, error) {
\tif b.n > 0 {
\t\treturn b.n, nil
\t}
\tf := func(x int) int {
\t\treturn x
\t}
\treturn f(1), nil // }
}

func main() {
\tfmt.Println("}{", '{')
}
"""
JAVA = """package a.b;
/** class X { */
public class Outer<T> implements I {
    private int n = 3;
    @Override
    public String name(int a, String b) throws E {
        switch (a) { case 1: break; }
        Runnable r = () -> { go(); };
        return "}" + '}';
    }
    static class Inner {
        void run() { while (true) { stop(); } }
    }
    enum Kind { A, B }
}
"""
RUST = """mod shapes {
    pub struct Dot { x: i32 }
    impl Show for Dot {
        fn show(&self) -> String {
            match self.x { 1 => { one() } _ => two() }
        }
    }
}
fn main() { let s = r#"}{"#; }
"""


def test_hand_checked_files():
    assert nesting.symbols_of(JS) == [
        ("Shop", "class", 5, 18, 1), ("Shop.constructor", "method", 6, 8, 2), ("Shop.find", "method", 9, 17, 2), ("Shop.find.inner", "function", 11, 13, 3), ("Shop.find.each", "function", 14, 16, 3),
        ("outer", "function", 19, 21, 1), ("arrow", "function", 22, 24, 1),
    ]
    assert nesting.symbols_of(GO, False, True) == [("Box", "struct", 3, 5, 1), ("Get", "function", 7, 15, 1), ("Get.f", "function", 11, 13, 2), ("main", "function", 17, 19, 1)]
    assert nesting.symbols_of(JAVA, False) == [("Outer", "class", 3, 15, 1), ("Outer.name", "method", 5, 10, 2), ("Outer.Inner", "class", 11, 13, 2), ("Outer.Inner.run", "method", 12, 12, 3), ("Outer.Kind", "enum", 14, 14, 2)]
    assert [(s, k, b) for s, k, _, b, _ in nesting.symbols_of(RUST, False)] == [("shapes", "mod", 8), ("shapes.Dot", "struct", 2), ("shapes.Dot", "impl", 7), ("shapes.Dot.show", "function", 6), ("main", "function", 9)]


def test_odd_texts(spark):
    assert nesting.symbols_of("") == [] == nesting.symbols_of("}}}{{{ '\" `")
    assert nesting.symbols_of("function open() {\n x\n") == [("open", "function", 1, 3, 1)]
    assert nesting.symbols_of("x = `" + "${`" * 30) == []
    rows = [("a/x.js", JS), ("b.py", "def f(): {}"), ("c.go", None), ("d.rs", "")]
    got = nesting.nested_symbols(spark.createDataFrame([(*r, "clash") for r in rows], "path string, text string, symbol string")).collect()
    assert {r.path for r in got} == {"a/x.js"} and len(got) == 7
