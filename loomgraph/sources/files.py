"""Projects on a file system: discovery, metadata, commit logs and source texts."""

from __future__ import annotations

import os
import re
import subprocess
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.edges import parse_log

EXCLUDED = {"renv", "packrat", ".Rproj.user", "node_modules", ".git"}
STALE_EXCLUDED = {"renv", "packrat", "_targets", ".loomgraph", "node_modules", ".git"}


@dataclass
class Project:
    root: str
    type: str
    r_files: list[str] = field(default_factory=list)
    test_files: list[str] = field(default_factory=list)
    rmd_files: list[str] = field(default_factory=list)
    qmd_files: list[str] = field(default_factory=list)
    description: dict[str, str] = field(default_factory=dict)


def listing(root: str, suffix: str, excluded: set[str] = EXCLUDED) -> list[str]:
    out = []
    for top, folders, names in os.walk(root):
        folders[:] = sorted(d for d in folders if d not in excluded)
        out += [os.path.join(top, n) for n in sorted(names) if n.endswith(suffix)]
    return sorted(out)


def read_dcf(path: str) -> dict[str, str]:
    """The first record of a file of 'Key: value' lines; indented lines go on with a value."""
    out: dict[str, str] = {}
    key = None
    with open(path, encoding="utf-8", errors="replace") as f:
        for line in f:
            if not line.strip():
                if out:
                    break
                continue
            m = re.match(r"([A-Za-z][A-Za-z0-9_.@/-]*):\s*(.*)", line)
            if m and not line[0].isspace():
                key = m.group(1)
                out[key] = m.group(2).strip()
            elif key:
                out[key] += "\n" + line.strip()
    return out


def project_type(root: str) -> str:
    there = set(os.listdir(root))
    if "DESCRIPTION" in there:
        return "package"
    if "app.R" in there or {"ui.R", "server.R"} <= there:
        return "shiny"
    if "_quarto.yml" in there or any(n.endswith(".qmd") for n in there):
        return "quarto"
    return "rmarkdown" if any(n.endswith(".Rmd") for n in there) else "script"


def detect(path: str = ".") -> Project:
    root = os.path.abspath(path)
    if not os.path.isdir(root):
        raise NotADirectoryError(path)
    found = listing(root, ".R")
    tests = os.path.join(root, "tests", "testthat") + os.sep
    description = os.path.join(root, "DESCRIPTION")
    return Project(root, project_type(root), found, [p for p in found if p.startswith(tests)], listing(root, ".Rmd"), listing(root, ".qmd"), read_dcf(description) if os.path.exists(description) else {})


def find_description(root: str) -> str | None:
    """In the folder, its parent, or that one's parent."""
    at = os.path.abspath(root)
    for _ in range(3):
        if os.path.exists(os.path.join(at, "DESCRIPTION")):
            return os.path.join(at, "DESCRIPTION")
        at = os.path.dirname(at)
    return None


def texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, text of whole files; no rows for no paths.  Local files that can't be read are left out with a warning."""
    readable = []
    for p in paths:
        if "://" in p or os.access(p, os.R_OK) and os.path.isfile(p):
            readable.append(p)
        else:
            warnings.warn(f"{p} can't be read", stacklevel=2)
    if not readable:
        return spark.createDataFrame([], "path string, text string")
    raw = spark.read.text([p if "://" in p else "file://" + p for p in readable], wholetext=True)
    return raw.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("path"), F.col("value").alias("text"))


def stem(path):
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def git_log(spark: SparkSession, root: str) -> DataFrame:
    """commit_id, file of the commits that added or changed sources; none, with a warning, without git or a repository."""
    try:
        run = subprocess.run(["git", "-C", root, "log", "--name-only", "--format=%H", "--diff-filter=ACMR", "--", "*.R"], capture_output=True, text=True)
    except OSError:
        run = None
    if run is None or run.returncode:
        warnings.warn(f"no commit log for {root}", stacklevel=2)
        return spark.createDataFrame([], "commit_id string, file string")
    lines = [(0, i, line) for i, line in enumerate(run.stdout.split("\n"))]
    return parse_log(spark.createDataFrame(lines, "log int, line_no long, line string"))


DEPENDENCY_FIELDS = ("Imports", "Suggests", "Depends", "LinkingTo")


def inventory(description: dict[str, str], versions: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """The packages of the dependency fields, each once, with their versions where these are known."""
    names: dict[str, None] = {}
    for key in DEPENDENCY_FIELDS:
        for part in description.get(key, "").split(","):
            name = re.sub(r"\s*\(.*\)", "", part, flags=re.S).strip()
            if name and name != "R":
                names[name] = None
    return [(n, (versions or {}).get(n, "unknown")) for n in names]


KINDS = {"package": "R package", "shiny": "Shiny application", "quarto": "R Markdown or Quarto project", "rmarkdown": "R Markdown or Quarto project", "script": "R project"}


def kind_label(project: Project) -> str:
    """The project's kind in words; a package's own Type field first."""
    return project.description.get("Type") or KINDS[project.type]


def exported(root: str) -> list[str] | None:
    """Names that a NAMESPACE file exports one by one; None without the file."""
    path = os.path.join(root, "NAMESPACE")
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8", errors="replace") as f:
        return [m.group(1) for line in f if (m := re.match(r'\s*export(?:Methods)?\(\s*["`]?([^",`()\s]+)["`]?\s*\)', line))]


def is_stale(root: str, cache: str) -> bool:
    """Whether a source is newer than the cache; true without a cache, false without sources."""
    if not os.path.exists(cache):
        return True
    found = listing(root, ".R", STALE_EXCLUDED)
    return bool(found) and max(os.path.getmtime(p) for p in found) > os.path.getmtime(cache)
