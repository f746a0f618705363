"""JSON arrays and objects read by byte ranges equal the whole-file readers."""

import json
import os

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidings.operators import labels as L
from tidings.sources import json_split as J
from tidings.sources import readers as RD

TEXT = st.text(alphabet='ab"\\{}[],: \n\té漢', max_size=12)
VALUE = st.recursive(st.one_of(TEXT, st.integers(-5, 5), st.none(), st.booleans()),
                     lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(TEXT, x, max_size=3)), max_leaves=6)
LAYOUT = st.sampled_from([{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False, "indent": 1}])


def _in_ranges(data: bytes, step: int):
    f = pa.BufferReader(data)
    own = [("f", a, min(a + step, len(data)), False, 0) for a in range(0, max(len(data), 1), step)]

    def bounds(r):
        return [J._outside_escape(f, x, len(data)) for x in r[1:3]]
    ranges = J.fold(own, [J.scan(data[a:b]) for a, b in map(bounds, own)])
    if ranges is None:
        return None
    out = []
    for r in ranges:
        a, b = bounds(r)
        for batch in J._entries("f", f, len(data), a, b, data[a:b], bool(r[3]), r[4]):
            out += zip(batch.column("offset").to_pylist(), batch.column("entry").to_pylist())
    assert [o for o, _ in out] == sorted({o for o, _ in out})
    return [t for _, t in out]


@settings(max_examples=300, deadline=None)
@given(st.lists(VALUE, max_size=6), LAYOUT, st.integers(1, 40), st.integers(1, 30))
def test_entries_of_arrays(values, layout, step, more):
    before, J.MORE_BYTES = J.MORE_BYTES, more
    try:
        got = _in_ranges(json.dumps(values, **layout).encode(), step)
    finally:
        J.MORE_BYTES = before
    assert [json.loads(t) for t in got] == values


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(TEXT, VALUE, max_size=6), LAYOUT, st.integers(1, 40))
def test_entries_of_objects(values, layout, step):
    got = _in_ranges(b" \n" + json.dumps(values, **layout).encode() + b"\n ", step)
    assert [json.loads("{" + t + "}") for t in got] == [{k: v} for k, v in values.items()]


@pytest.mark.parametrize("data", [b"", b"[1, 2", b'["a]', b"[1]]", b"]1[", b'{"a": [1}', b'["x\\"]'])
@pytest.mark.parametrize("step", [1, 3, 100])
def test_malformed_files_have_no_entries(data, step):
    assert _in_ranges(data, step) is None


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_articles_equal_the_whole_file_reader(spark, tmpdir_path):
    arts = [{"id": f"a/{i}", "type": None if i % 3 else "article", "webTitle": 'say "no" \\ ' * (i % 4), "fields": {"bodyText": "é\n漢 ]}, " * (i % 9)}} for i in range(40)]
    paths = [os.path.join(tmpdir_path, n) for n in ("one.json", "two.json", "none.json")]
    for p, text in zip(paths, (json.dumps(arts, indent=2), json.dumps(arts[:7], ensure_ascii=False), " [ ] ")):
        _write(p, text)
    _write(os.path.join(tmpdir_path, "bad.json"), json.dumps(arts[:3])[:-1])
    want = sorted(map(str, RD.read_articles(spark, paths).collect()))
    for range_bytes in (700, 1 << 20):
        df = J.read_articles_split(spark, tmpdir_path, range_bytes=range_bytes)
        assert sorted(map(str, df.collect())) == want
        assert (df.rdd.getNumPartitions() > 3) == (range_bytes == 700)
    assert [r.file.rsplit("/", 1)[1] for r in J.malformed(spark, tmpdir_path).collect()] == ["bad.json"]
    assert J.read_articles_split(spark, tmpdir_path, flat=False, range_bytes=900).columns == RD.ARTICLE.fieldNames()


def test_label_maps_equal_the_whole_file_reader(spark, tmpdir_path):
    body = {f'a/{i}"\\': (i % 9) / 2 for i in range(60)}
    _write(os.path.join(tmpdir_path, "m1.json"), json.dumps(body, indent=2))
    _write(os.path.join(tmpdir_path, "m2.json"), '{"x": 1, "y": 2.5,\n"x" : 3, "z": null}')
    _write(os.path.join(tmpdir_path, "m3.json"), '{"x": "word", "w": 1}')
    want = {(r.src_file, r.article_id): r.label for r in RD.read_label_map(spark, tmpdir_path, rater="a").collect()}
    for range_bytes in (250, 1 << 20):
        got = J.read_label_map_split(spark, tmpdir_path, rater="a", range_bytes=range_bytes)
        assert {(r.src_file, r.article_id): r.label for r in got.collect()} == want and got.columns == ["article_id", "rater", "label", "src_file", "pos"]
    assert want[("m2.json", "x")] == 3.0 and L.merge_label_files(got).count() == 63
    ints = J.read_label_map_split(spark, os.path.join(tmpdir_path, "m2.json"), as_int=True)
    assert {r.article_id: r.label for r in ints.collect()} == {"x": 3.0, "y": 2.0, "z": None}
