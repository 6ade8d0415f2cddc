"""One JSON object read by byte ranges equals the parsed object."""

import json
import random

import pytest

from rolefit.sources.json_object import json_object_members

TRICKY = {"plain": 1, "quo\"te": "a \"b\" {c} [d], \\ e", "": {}, "brace}": {"x": [1, {"y": "}"}], "z": "],["}, "back\\": "\\\\", "back\\\\": "\\\"",
          "ü🎈": "ñ\n\t\u0000", "null": None, "list": [[], {}, ",", ":"], "long": "x\\" * 300, "nested": {"a": {"b": {"c": [1, 2, {"d": "e,f"}]}}}}


@pytest.mark.parametrize("range_bytes", [1, 2, 7, 64, 10_000])
@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}])
def test_members_by_ranges(spark, tmp_path, range_bytes, layout):
    if range_bytes < 7 and layout:
        pytest.skip("one layout is enough for the smallest ranges")
    rnd = random.Random(5)
    objects = {"a": TRICKY, "b": {f"k{i}": {"n": "".join(rnd.choices('ab"\\{}[],: ', k=rnd.randint(0, 12)))} for i in range(40)}, "c": {}}
    if range_bytes < 7:
        objects = {"a": {k: v for k, v in TRICKY.items() if k != "long"}, "c": {}}
    for name, value in objects.items():
        (tmp_path / f"{name}.json").write_text("  " + json.dumps(value, **layout) + "\n", encoding="utf-8")
    df = json_object_members(spark, str(tmp_path), range_bytes)
    got = {}
    for r in df.collect():
        assert r.key not in got.setdefault(r.path[-6], {})
        got[r.path[-6]][r.key] = json.loads(r.value)
    assert got == {k: v for k, v in objects.items() if v}
    assert range_bytes > 64 or df.rdd.getNumPartitions() > 5


def test_no_file_has_bytes(spark, tmp_path):
    (tmp_path / "empty.json").write_text("")
    assert json_object_members(spark, str(tmp_path)).collect() == []
