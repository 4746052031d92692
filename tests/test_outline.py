"""Nested heads of notes."""

from tessera.operators import outline


def test_maps_and_lists_in_each_other():
    head = """a: 1
b:
  c: 'it: is'   # remark
  d:
  - x: 1
    y: [p, "q, r", 's']
  -   x: 2
      z:
        deep: yes
  e: "has # sign"
list:
- one
- two: 2
- - in
  - out
# remark

long: |
  first line
  second line
empty:
url: http://host/path
tail: end"""
    got = outline.folded(head)
    assert got == [
        ("a", "1"), ("b.c", "it: is"), ("b.d.0.x", "1"), ("b.d.0.y.0", "p"), ("b.d.0.y.1", "q, r"), ("b.d.0.y.2", "s"), ("b.d.1.x", "2"), ("b.d.1.z.deep", "yes"), ("b.e", "has # sign"),
        ("list.0", "one"), ("list.1.two", "2"), ("list.2.0", "in"), ("list.2.1", "out"), ("long", "first line second line"), ("url", "http://host/path"), ("tail", "end"),
    ]


def test_odd_heads():
    assert outline.folded(None) == outline.folded("") == outline.folded("\n# only\n") == []
    assert outline.folded("just words") == []
    assert outline.folded("- a\n- b") == [("0", "a"), ("1", "b")]
    assert outline.folded("k: []") == [] and outline.folded("\tk: v") == [("k", "v")]
    deep = "\n".join(" " * n + f"k{n}:" for n in range(200)) + "\n" + " " * 200 + "v: 1"
    assert outline.folded(deep) == [(".".join(f"k{n}" for n in range(200)) + ".v", "1")]


def test_fields_of_notes(spark):
    notes = spark.createDataFrame([("a", "---\nm:\n  - x\n---\nbody: no"), ("b", "no head"), ("c", None)], "path string, content string")
    assert [tuple(r) for r in outline.head_fields(notes).collect()] == [("a", "m.0", "x")]
