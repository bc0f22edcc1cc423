"""Workers need not have the package: what runs in tasks travels with the job."""

import os
import subprocess
import sys
import tempfile

SF = "/root/testdata/sf0.001"
QUERIES = ("op1_quality_model", "op3_shingle_join", "op5_secret_scans", "op6_bpe", "op7_decontaminate", "op8_class_lm", "op9_repeats", "op10_warc", "op11_whitening", "op12_html_extract",
           "op13_prefix_trie")


def test_workers_do_not_need_the_package():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from corpusframe.settings import session
from corpusframe.llm.queries import QUERIES
s = session(master='local[4]', **{{'spark.ui.enabled': 'false', 'spark.sql.shuffle.partitions': '2'}})
print('ROWS', *[QUERIES[n](s, {SF!r}).count() > 0 for n in {QUERIES!r}])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(prefix="spark-"), env=env, capture_output=True, text=True, timeout=900)
    assert "ROWS" + " True" * len(QUERIES) in out.stdout, out.stderr[-2000:]
