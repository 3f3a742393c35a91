import hashlib
import json

import pytest

from meshweave.plans.patterns import CombineOp, ConcatDim, FilePattern, FileType, MergeDim, Resume, merkle_chain, pattern_from_file_sequence


YEARS, LEVELS = (1998, 1999, 2003, 2004), ("surface", "500hPa", "top")


@pytest.fixture
def pattern():
    return FilePattern(lambda level, year: f"https://data.example/{year}/{level}.nc", ConcatDim("year", YEARS, nitems_per_file=12), MergeDim("level", LEVELS))


def test_metadata(pattern):
    assert pattern.dims == {"year": 4, "level": 3} and pattern.shape == (4, 3) and len(pattern) == 12
    assert (pattern.merge_dims, pattern.concat_dims) == (["level"], ["year"])
    assert pattern.nitems_per_input == {"year": 12} and pattern.concat_sequence_lens == {"year": 48}
    assert [d.operation for d in pattern.combine_dim_keys] == [CombineOp.CONCAT, CombineOp.MERGE]


def test_items_last_axis_fastest(pattern, spark):
    expected = [(y, v, f"https://data.example/{year}/{level}.nc") for y, year in enumerate(YEARS) for v, level in enumerate(LEVELS)]
    assert [(at["year"], at["level"], url) for at, url in pattern.items()] == expected
    assert [(r.year_pos, r.level_pos, r.url) for r in pattern.files(spark).orderBy("row").collect()] == expected
    assert all(pattern[{"level": v, "year": y}] == url for y, v, url in expected)
    with pytest.raises(KeyError):
        pattern[{"year": 1}]


@pytest.mark.parametrize("nkeep", [1, 2, 3, 9])
def test_prune(pattern, nkeep):
    kept = pattern.prune(nkeep)
    assert [url for _, url in kept.items()] == [f"https://data.example/{year}/{level}.nc" for year in YEARS[:nkeep] for level in LEVELS]
    assert pattern.prune().dims["year"] == 2


def test_file_type():
    assert FilePattern(str, file_type="zarr").file_type is FileType.zarr
    with pytest.raises(ValueError):
        FilePattern(str, file_type="other")
    with pytest.raises(ValueError):
        FilePattern(str, open_options={"a": 1}, file_type="opendap")


def test_chain_and_resume(spark):
    old = pattern_from_file_sequence(["x/1", "x/2"], "time", file_type="zarr")
    new = pattern_from_file_sequence(["x/1", "x/2", "x/7"], "time", file_type="zarr")
    root = hashlib.sha256(json.dumps({"file_type": "zarr", "nitems_per_file": {"time": None}}, separators=(",", ":")).encode()).digest()
    assert old.get_merkle_list()[0] == root
    assert new.get_merkle_list()[:3] == old.get_merkle_list()
    assert new.resume(old.sha256()) == (Resume.APPEND_AT, {"time": 2})
    assert new.start_processing_from(old.sha256()) == {"time": 2}
    assert new.resume(new.sha256()) == (Resume.IDENTICAL, None)
    assert new.resume(b"x") == (Resume.UNRELATED, None)
    rows = merkle_chain(new.files(spark).select("row", "url"), root).orderBy("n").collect()
    assert [r.hash for r in rows] == [h.hex() for h in new.get_merkle_list()]
