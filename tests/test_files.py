"""Files that queries write for their readers."""

from pathlib import Path
from urllib.parse import unquote, urlparse

from framewise.plans import catalog
from framewise.plans.catalog import files


def test_annotations_are_read_from_many_files(spark, monkeypatch):
    """One task reads a whole XML file, so files must not grow with the table."""
    monkeypatch.setattr(files, "ANNOTATIONS", 1000)
    out = catalog.QUERIES["s7_read_annotations"](spark, "/root/testdata/sf0.001")
    assert len(out.inputFiles()) >= 6
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_annotations_are_compressed(spark):
    """Plain XML takes some 560 bytes to an object, most of them names of fields."""
    out = catalog.QUERIES["s7_read_annotations"](spark, "/root/testdata/sf0.001")
    size = sum(Path(unquote(urlparse(f).path)).stat().st_size for f in out.inputFiles())
    assert size < 60 * out.count()
