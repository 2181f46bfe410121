"""Analytics over software-project artefacts and text corpora as Spark DataFrame plans."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

_shipped: set[str] = set()


def ship(spark) -> None:
    """Give the package to the executors, as ``--py-files`` does, once for each application.

    Operators with Python code need it there. Not needed where the package is installed on the workers.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    packed = shutil.make_archive(f"{tempfile.mkdtemp(prefix='siltstone-')}/siltstone", "zip", here.parent, here.name)
    context.addPyFile(packed)
    _shipped.add(context.applicationId)
