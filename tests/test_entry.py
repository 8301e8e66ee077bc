import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
for gone in {gone}:
    sys.modules[gone] = None
import __spark_entry__ as e
names = list(e.queries())
print(len([n for n in names if n.startswith("op") or n == "pipeline"]), "R10_hybrid" in names, set(e.oracle_sql()) <= set(names))
"""


def run(gone):
    done = subprocess.run([sys.executable, "-c", CODE.format(gone=gone)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    return done.stdout.strip(), done.stderr


def test_entry_without_the_training_data_folder():
    assert run(["folioseek.llm", "corpus_pipeline"]) == ("0 True True", "")
    assert run(["corpus_pipeline"]) == ("0 True True", "")


def test_entry_hides_no_other_missing_module():
    if os.path.isdir(os.path.join(ROOT, "folioseek", "llm")):
        assert "ModuleNotFoundError" in run(["xxhash"])[1]
    assert "ModuleNotFoundError" in run(["folioseek.operators.keyword"])[1]


def test_bench_has_all_names():
    import ast
    import builtins

    sys.path.insert(0, ROOT)
    import bench

    with open(os.path.join(ROOT, "bench.py")) as f:
        tree = ast.parse(f.read())
    bound = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)} | {a.arg for a in ast.walk(tree) if isinstance(a, ast.arg)}
    bound |= {f.name for f in ast.walk(tree) if isinstance(f, ast.FunctionDef)}
    used = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)}
    assert used <= bound | set(dir(bench)) | set(dir(builtins))
