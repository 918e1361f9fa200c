"""What steps leave in the Python workers, which Spark uses again for the next ones."""
import re
from pathlib import Path

import public_tokenizers
import pytest

from parleo.llm import packing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def workers_mb(spark):
    """Memory of all processes below the JVM."""
    of = {int(m[1]): int(m[2]) for p in Path("/proc").glob("[0-9]*/stat") if (m := re.match(r"(\d+) \(.*\) \S (\d+)", _read(p)))}
    top = spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()
    below, known = [], {top}
    while new := {p for p, up in of.items() if up in known} - known:
        known |= new
        below += new
    return sum(int(x) for p in below for x in re.findall(r"\nPss_Anon:\s+(\d+)", _read(Path(f"/proc/{p}/smaps_rollup")))) / 1024


def _read(path):
    try:
        return path.read_text()
    except OSError:
        return ""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory is read from /proc")
def test_packing_leaves_no_memory_in_its_worker(spark):
    docs = spark.range(0, 6000, 1, 1).selectExpr(
        "id AS doc_id", "array_join(transform(sequence(1, 400), k -> concat('w', translate(conv(pmod(xxhash64(id, k), 150000), 10, 26), '0123456789', 'qrstuvwxyz'))), ' ') AS text")
    packing.pieces(docs.limit(1), TOKENIZER).collect()
    before = workers_mb(spark)
    rows = packing.pieces(docs, TOKENIZER).groupBy().sum("length").collect()
    after = workers_mb(spark)
    assert rows[0][0] > 6000 * 400
    assert after - before < 35
