from __future__ import annotations

import os

from plumbline import session


def test_scratch_is_released_and_cleared(spark):
    one, two = (session.materialize(spark.range(5), "t") for _ in range(2))
    folders = [df._plumbline_path.removeprefix("file:") for df in (one, two)]
    folders = ["/" + f.lstrip("/") for f in folders]
    assert all(map(os.path.isdir, folders)) and one.count() == 5
    session.release(one, spark.range(1))
    assert not os.path.isdir(folders[0]) and os.path.isdir(folders[1])
    session.clear_scratch(spark)
    assert not os.path.isdir(folders[1])


def test_the_configured_folder_is_used(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    assert session.shared_dir(spark) == named.rstrip("/") if named else session.shared_dir(spark).startswith("file:")
    assert session.scratch_path(spark, "a") != session.scratch_path(spark, "a")
