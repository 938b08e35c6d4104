import subprocess
import sys

# The function that pack() gives to mapInArrow, in a process of its own, over texts of ever new words.
WORKER = """
import random, re, resource, sys
from pathlib import Path
from types import SimpleNamespace
import pyarrow as pa
from pyspark import TaskContext
from tessera.llm import packing

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024

class Docs:
    schema = {"doc_id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))}
    select = lambda self, *cols: self
    mapInArrow = lambda self, run, schema: run

TaskContext.get = classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 0))
rng = random.Random(5)

def batches():
    for i in range(2):
        texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(100)) for _ in range(1000)]
        yield pa.RecordBatch.from_arrays([pa.array(range(1000 * i, 1000 * i + 1000)), pa.array(texts)], ["doc_id", "text"])

packing.tokens_of(None)
run = packing.pack(Docs())
began = held()
docs, tokens, total = set(), 0, 0
for out in run(batches()):
    docs |= set(out.column(0).to_pylist())
    tokens += sum(out.column(2).to_pylist())
    total += sum(n for n, start in zip(out.column(4).to_pylist(), out.column(1).to_pylist()) if start == 0)
del out
assert len(docs) == 2000 and tokens == total, (len(docs), tokens, total)
print(held() - began)
"""


def test_packing_gives_its_memory_back():
    """Workers wait for further tasks beside the JVM, so what they hold counts in stages without Python."""
    out = subprocess.run([sys.executable, "-c", WORKER], capture_output=True, text=True, check=True).stdout
    assert int(out.split()[-1]) < 100
