"""The content cache: new files, renamed and old ones, runs that break off."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources.content import ContentCache


def _converted(cache):
    return cache.results().count()


def test_equal_content_is_converted_once(spark, tmp_path):
    src = tmp_path / "in"
    (src / "a").mkdir(parents=True)
    cache, text = ContentCache(spark, str(tmp_path / "cache")), lambda c: F.upper(F.decode(c, "UTF-8"))
    (src / "a" / "1.txt").write_text("one")
    (src / "a" / "2.txt").write_text("one")
    (src / "empty.txt").write_text("")
    cache.refresh(str(src), text)
    assert _converted(cache) == 1
    # nothing new: no batch, no conversion
    batches = os.listdir(tmp_path / "cache" / "results")
    cache.refresh(str(src), lambda c: F.raise_error(F.lit("converted again")))
    assert os.listdir(tmp_path / "cache" / "results") == batches
    # a renamed file is read, its result is there, however old it is
    shutil.move(src / "a" / "2.txt", src / "renamed.txt")
    os.utime(src / "renamed.txt", (1_000_000_000, 1_000_000_000))
    cache.refresh(str(src), lambda c: F.raise_error(F.lit("converted again")).cast("string"))
    (src / "3.txt").write_text("three")
    cache.refresh(str(src), text)
    got = {os.path.basename(r.path): (r.result, r.reused) for r in cache.current().collect()}
    assert got == {"1.txt": ("ONE", False), "2.txt": ("ONE", False), "renamed.txt": ("ONE", True), "3.txt": ("THREE", False)}
    assert _converted(cache) == 2


def test_a_batch_that_failed_comes_again(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    cache = ContentCache(spark, str(tmp_path / "cache"))
    (src / "1.txt").write_text("one")
    with pytest.raises(Exception, match="broken"):
        cache.refresh(str(src), lambda c: F.raise_error(F.lit("broken")).cast("string"))
    (src / "2.txt").write_text("two")
    cache.refresh(str(src), lambda c: F.decode(c, "UTF-8"))
    assert sorted((r.result, r.reused) for r in cache.current().collect()) == [("one", False), ("two", False)] and _converted(cache) == 2
