"""Nested settings: paths, merges, shares, targets."""

from quillmill.functions import settings as S


def test_paths_and_merges():
    d = {"a": {"b": 1}, "l": [1]}
    assert S.get_path(d, "a.b") == 1 and S.get_path(d, "a.c", 5) == 5 and S.get_path(d, "l.b") is None
    assert S.set_path({"a": 3}, "a.b.c", 1) == {"a": {"b": {"c": 1}}}
    assert S.merged(d, {"a": {"c": 2}, "l": [2]}) == {"a": {"b": 1, "c": 2}, "l": [2]} and d == {"a": {"b": 1}, "l": [1]}
    assert S.nested({"a.b": 1, "a.c": 2, "d": 3}) == {"a": {"b": 1, "c": 2}, "d": 3}


def test_shares_and_targets():
    assert S.shares({" A ": "3", "b": 1, "c": -2, "d": "bad", "": 9}) == {"a": 0.75, "b": 0.25}
    assert S.shares({"a": 1, "b": 3}, ["b", "x"]) == {"b": 0.75, "x": 0.0} and S.shares({}) == {}
    assert S.export_targets({}, "Coco, native") == ["coco", "native"] and S.export_targets({"export_targets": "a,B"}) == ["a", "b"]
    assert S.export_targets({}) == ["native", "segformer", "coco"] and S.export_targets({"export_targets": []}) == ["native"] and S.export_targets({"export_targets": 3}) == ["native", "segformer", "coco"]
