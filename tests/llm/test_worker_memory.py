"""What a worker holds at a time."""

from __future__ import annotations

import os
import subprocess
import sys
import tracemalloc

import pyarrow as pa

from barloom.llm import near

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_words_of_a_coder_stay_small(tmp_path):
    """60 MB of ever new words; queries are left out, their memory isn't what grows."""
    code = f"""
import random, resource, sys
sys.path.insert(0, {ROOT!r})
import pyarrow as pa, public_tokenizers as P
from barloom.llm import bpe
class Plain(bpe.Coder):
    def encode_all(self, words):
        return pa.array([self.byte_ids[list(w)] for w in words], pa.list_(pa.int32()))
    def decode(self, lists):
        return ["".join(self.tokens[t].hex() for t in ids) for ids in lists.to_pylist()]
coder = Plain(open(P.path(bpe.VOCABULARY), "rb").read())
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rng = random.Random(1)
for _ in range(5):
    text = " ".join("%09x" % rng.getrandbits(36) for _ in range(400_000))
    batch = pa.RecordBatch.from_arrays([pa.array([text[i : i + 10_000] for i in range(0, len(text), 10_000)])], names=["t"])
    del text
    for part in bpe.slices([batch], "t", bpe.SLICE_BYTES):
        texts = [t.split() for t in part.column("t").to_pylist()]
        coder.learn({{w for ws in texts for w in ws}})
print("grown", (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=400)
    assert "grown" in done.stdout, done.stderr[-2000:]
    assert int(done.stdout.split("grown")[1].split()[0]) < 260, done.stdout


def test_groups_become_objects_a_few_at_a_time():
    groups = [[{"fp": i * 40 + j, "node": i * 40 + j, "label": i * 40 + j} for j in range(40)] for i in range(3000)]
    kind = pa.list_(pa.struct([("fp", pa.int64()), ("node", pa.int64()), ("label", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(groups, kind)], names=["found"])
    del groups
    tracemalloc.start()
    found = sum(part.num_rows for part in near._group_pairs([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 3000 * (39 + 38)
    assert most < 8e6
