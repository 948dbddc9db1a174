"""What an application keeps in the shared folder."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate()
from lemmata.shared import session_dir
path = session_dir(spark) + "/x"
spark.range(10).write.parquet(path)
print(spark.read.parquet(path).count(), session_dir(spark) == session_dir(spark))
"""


def test_folder_goes_with_the_application(tmp_path):
    done = subprocess.run([sys.executable, "-c", CODE, str(tmp_path)], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=120)
    assert done.stdout.split()[-2:] == ["10", "True"], done.stderr
    assert list((tmp_path / "lemmata").iterdir()) == []
