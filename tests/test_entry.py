"""The driver contract where the optional subpackage is broken, and the programs' output."""

import subprocess
import sys
from importlib.util import find_spec

from larkspur import console


def test_errors_inside_the_subpackage_pass_on():
    code = "import sys; sys.modules['larkspur.llm.queries'] = None; import __spark_entry__"  # an import that fails
    if find_spec("larkspur.llm") is None:
        return
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert done.returncode and "ModuleNotFoundError" in done.stderr


def test_console(capsys, monkeypatch):
    console.line("MATCH", "a -> b")
    console.progress("matching")
    console.summary("Summary", {"total": 3, "matching": 1.234})
    assert capsys.readouterr().out == "[MATCH] a -> b\nSummary\n  total: 3\n  matching: 1.23 s\n"
    monkeypatch.setattr(console.sys.stdout, "isatty", lambda: True, raising=False)
    monkeypatch.setenv("NO_COLOR", "1")
    assert console.painted("x", "red") == "x"
    monkeypatch.delenv("NO_COLOR")
    assert console.painted("x", "red") == "\033[31mx\033[0m"
