"""Requests for datasets, each rule by hand."""

from voxloom.operators import launch


def test_rules_of_download_requests(spark):
    asked = [
        (1, ["a", " a ", "b"], None), (2, ["c", "old"], None), (3, ["old", "c", "old2"], "skip"), (4, ["old"], "skip"), (5, ["old"], "overwrite"),
        (6, [], None), (7, None, "skip"), (8, ["a", "../x", ".."], None), (9, ["z1", "a", "z2", "z3", "z4"], "skip"), (10, ["a", None], None),
    ]
    requests = spark.createDataFrame(asked, "request int, datasets array<string>, existing_mode string")
    manifest = spark.createDataFrame([(n,) for n in ["a", "b", "c", "old", "old2", "old"]], "name string")
    present = spark.createDataFrame([("old",), ("old2",), ("other",), (None,)], "name string")
    got = {r.request: tuple(r[1:]) for r in launch.download_launch(requests, manifest, present).collect()}
    assert got == {
        1: (None, None, False, ["a", "b"], [], True),
        2: (None, ["old"], True, None, None, False),
        3: (None, None, False, ["c"], ["old", "old2"], False),
        4: ("nothing_to_download", None, False, None, None, False),
        5: (None, None, False, ["old"], [], True),
        6: ("missing_selection", None, False, None, None, False),
        7: ("missing_selection", None, False, None, None, False),
        8: ("invalid_dataset_name", ["../x"], False, None, None, False),
        9: ("unknown_dataset", ["z1", "z2", "z3"], False, None, None, False),
        10: ("invalid_dataset_name", [None], False, None, None, False),
    }
    unasked = launch.download_launch(requests, manifest, present, confirm=False).filter("request = 2").first()
    assert unasked.selected == ["c", "old"] and unasked.overwrite
    assert launch.download_launch(requests.filter("false"), manifest, present).count() == 0
