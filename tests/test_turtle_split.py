"""Turtle files read in splits against the reader of whole texts."""

import random

import pytest

from cellsense.sources import triples
from cellsense.sources.turtle import parse
from cellsense.sources.turtle_split import read_turtle_split, scan


def document(seed: int, n: int, blanks: bool) -> str:
    rng = random.Random(seed)
    inner = ['a "quoted" word.', "ends. \n@prefix no: <http://no/> .", "it's # no comment .", 'two "" quotes', "''' .", "line\nline .\n\nx", "\\\"\\\"\\\" .", ".", ""]

    def literal():
        x = rng.choice(inner)
        if rng.random() < 0.5:
            return '"""' + x.replace('"""', "") .rstrip('"') + '"""'
        if "\n" in x or '"' in x.replace('\\"', ""):
            return "'''" + x.replace("'''", "").rstrip("'") + "'''"
        return '"' + x + '"'

    out = ["# a comment with a quote \" and \"\"\" and a stop .", "@prefix a: <http://a/> .", "PREFIX b: <http://b/>", "@base <http://base/> ."]
    for i in range(n):
        kind = rng.random()
        if kind < 0.1:
            out.append(rng.choice([f"@prefix a: <http://a{i}/> .", f"BASE <http://base{i}/>", f"@prefix p{i}:\n  <http://p/> .", "# only .", ""]))
            continue
        s = rng.choice([f"a:s{i}", "<http://x/y#z>", "b:t", f"<rel{i}>", "_:n1"])
        objects = [rng.choice([literal(), literal() + "@en", f"{rng.randint(0, 9)}.5", "7", "b:o.x", "<http://q/'w'#.>", *(["[ a:p [] ; a:q 'x' ]", "( 1 2 )"] if blanks else [])]) for _ in range(rng.randint(1, 3))]
        sep = rng.choice([" ", "\n  "])
        out.append(f"{s}{sep}a:p{sep}{f',{sep}'.join(objects)}{sep if rng.random() < 0.7 else ' '}. " + rng.choice(["", "# note \" .", "  "]))
    return rng.choice(["\n", "\r\n"]).join(out) + rng.choice(["", "\n"])


@pytest.mark.parametrize("size", [97, 1000, 100_000])
def test_splits_give_the_triples_of_the_whole(spark, tmp_path, size):
    texts = {f"f{i}.ttl": document(i, 60, blanks=False) for i in range(4)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = sorted((tuple(r) for r in read_turtle_split(spark, str(tmp_path)).collect()), key=str)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > (20 if size == 97 else 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = sorted((t for name, text in texts.items() for t in parse(text, name)), key=str)
    assert len(want) > 300 and got == want


def test_nodes_without_a_name_stay_apart(spark, tmp_path):
    text = document(9, 40, blanks=True)
    (tmp_path / "f.ttl").write_text(text, newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = [tuple(r) for r in read_turtle_split(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = parse(text, "f.ttl")
    nodes = lambda ts: {x for t in ts for x in (t[0], t[2]) if str(x).startswith("_:")}
    plain = lambda ts: sorted((tuple("_" if str(x).startswith("_:f.ttl##") else x for x in t) for t in ts), key=str)
    assert len(nodes(got)) == len(nodes(want)) > 10 and plain(got) == plain(want)


def test_what_is_no_turtle(spark, tmp_path):
    (tmp_path / "bad.ttl").write_text("@prefix a: <http://a/> .\na:s a:p 1 .\na:s a:p ?? .\na:s a:p 3 .\n")
    assert read_turtle_split(spark, str(tmp_path), strict=False).count() == 2
    with pytest.raises(Exception, match=r"statement 2: bad.ttl"):
        read_turtle_split(spark, str(tmp_path)).collect()


def test_lines_map_states():
    assert scan('a b """x', 0) == (1, False) and scan('y""" .', 1) == (0, True) and scan("it's '''", 1) == (1, False)
    assert scan("<http://a#b> . # c \"\"\"", 0) == (0, True) and scan("# .", 0) == (0, False) and scan("'''.''' .", 0) == (0, True) and scan("x 1.", 2) == (2, False)


def test_an_empty_folder_of_statements(spark, tmp_path):
    (tmp_path / "e.ttl").write_text("")
    assert read_turtle_split(spark, str(tmp_path)).count() == 0 and triples.read_turtle(spark, str(tmp_path)).count() == 0
