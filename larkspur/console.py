"""What the programs print: labelled lines, progress, a summary. Colour needs a terminal and no NO_COLOR."""

from __future__ import annotations

import os
import sys

COLORS = {"green": 32, "yellow": 33, "red": 31, "cyan": 36}


def painted(text: str, color: str) -> str:
    plain = not sys.stdout.isatty() or os.environ.get("NO_COLOR")
    return text if plain else f"\033[{COLORS[color]}m{text}\033[0m"


def line(label: str, text: str, color: str = "green") -> None:
    print(f"{painted(f'[{label}]', color)} {text}")


def progress(step: str) -> None:
    """The step a program is at, in place; nothing where output is not a terminal."""
    if sys.stdout.isatty():
        print(f"\r\033[K{step} ...", end="", flush=True)


def summary(title: str, values: dict[str, object]) -> None:
    if sys.stdout.isatty():
        print("\r\033[K", end="")
    print(painted(title, "cyan"))
    for name, value in values.items():
        print(f"  {name}: {value:.2f} s" if isinstance(value, float) else f"  {name}: {value}")
