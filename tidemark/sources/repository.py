"""A git repository as changed files, line counts and file contents.

git runs where the driver runs; what it prints becomes one row a call and is taken apart by the
decoders of sources.git. A listing exported elsewhere goes through the same decoders.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.paths import clean
from tidemark.sources.git import NameStatus, Numstat, nul_list

#: Bytes of paths given to one call.
ARGUMENT_BYTES = 96 * 1024
# Branches that are looked for where the remote names none.
BRANCHES = ("main", "master", "trunk", "develop")
CHANGED = "path string, status string, old_path string, additions long, deletions long"

Runner = Callable[[Sequence[str]], bytes]


class GitError(RuntimeError):
    """A git call that failed, with what it said."""


def checked_ref(ref: str) -> str:
    """a revision of letters, digits and ._/-:@~^ that does not begin with a dash; empty is allowed."""
    if ref.startswith("-"):
        raise ValueError(f"invalid ref {ref!r}: cannot start with '-'")
    if not re.fullmatch(r"[A-Za-z0-9._/\-:@~^]*", ref):
        raise ValueError(f"invalid ref {ref!r}: contains unsupported character")
    return ref


def batches(paths: Sequence[str], most: int = ARGUMENT_BYTES) -> Iterator[list[str]]:
    """Runs of paths with most bytes at most, one more for each path; a longer path stands alone. No bound, one run."""
    held: list[str] = []
    used = 0
    for p in paths:
        size = len(p.encode()) + 1
        if held and most > 0 and used + size > most:
            yield held
            held, used = [], 0
        held.append(p)
        used += size
    if held:
        yield held


class Repository:
    """Git calls in a folder. run: takes the arguments, gives the output; tests put their own in."""

    def __init__(self, spark: SparkSession, folder: str = ".", run: Runner | None = None) -> None:
        self.spark, self.folder, self.run = spark, folder, run or self._git

    def _git(self, arguments: Sequence[str]) -> bytes:
        done = subprocess.run(["git", *arguments], cwd=self.folder, capture_output=True, timeout=120, check=False)
        if done.returncode:
            raise GitError(done.stderr.decode(errors="replace").strip())
        return done.stdout

    def _rows(self, *arguments: str) -> DataFrame:
        return self.spark.createDataFrame([(self.run(arguments).decode(errors="replace"),)], "content string")

    def _changes(self, *which: str) -> DataFrame:
        files = self._rows("diff", "--name-status", "-z", *which).lateralJoin(NameStatus(F.col("content").outer())).drop("content")
        counts = self._rows("diff", "--numstat", "-z", *which).lateralJoin(Numstat(F.col("content").outer())).drop("content")
        return files.join(counts, "path", "left").fillna(0, ["additions", "deletions"])

    def diff(self, base: str = "", head: str = "") -> DataFrame:
        """Path, status, old_path, additions, deletions between two revisions, or one (HEAD without any) and the working tree."""
        base, head = checked_ref(base), checked_ref(head)
        if base and head:
            return self._changes(f"{base}..{head}")
        return self._changes(base or head or "HEAD")

    def staged(self) -> DataFrame:
        """The index against HEAD."""
        return self._changes("--cached")

    def unstaged(self) -> DataFrame:
        """The working tree against the index."""
        return self._changes()

    def all_changes(self) -> DataFrame:
        """Index and working tree against HEAD."""
        return self.diff()

    def _names(self, *arguments: str) -> DataFrame:
        return self._rows(*arguments).select(F.explode(nul_list(F.col("content"))).alias("path"))

    def untracked(self) -> DataFrame:
        return self._names("ls-files", "--others", "--exclude-standard", "-z")

    def unstaged_files(self) -> DataFrame:
        """Tracked files with unstaged changes and untracked ones, cleaned, distinct, sorted."""
        both = self._names("diff", "--name-only", "-z").unionByName(self.untracked())
        return both.select(clean(F.col("path")).alias("path")).distinct().orderBy("path")

    def line_counts(self, base: str, paths: Sequence[str]) -> DataFrame:
        """Path, additions, deletions of the files against a revision, in as many calls as their names need."""
        base = checked_ref(base)
        out = [(self.run(["diff", "--numstat", "-z", base, "--", *some]).decode(errors="replace"),) for some in batches(paths)]
        return self.spark.createDataFrame(out, "content string").lateralJoin(Numstat(F.col("content").outer())).drop("content")

    def exists(self, ref: str, path: str) -> bool:
        """S13."""
        if not path:
            raise ValueError("invalid file path: empty")
        try:
            self.run(["cat-file", "-e", f"{checked_ref(ref)}:{path}"])
        except GitError as e:
            if re.search(r"does not exist|exists on disk, but not in|not a valid object name|bad revision", str(e), re.I):
                return False
            raise
        return True

    def show(self, ref: str, path: str) -> str:
        """A file's content at a revision."""
        if not path:
            raise ValueError("invalid file path: empty")
        return self.run(["show", f"{checked_ref(ref)}:{path}"]).decode(errors="replace")

    def contents(self, ref: str, paths: Sequence[str]) -> DataFrame:
        """File and content at a revision; null where the revision has no such file."""
        rows = [(p, self.show(ref, p) if self.exists(ref, p) else None) for p in paths]
        return self.spark.createDataFrame(rows, "file string, content string")

    def default_branch(self) -> str:
        """The branch that the remote's HEAD names, else the first well-known one that exists."""
        try:
            name = self.run(["symbolic-ref", "--quiet", "--short", "refs/remotes/origin/HEAD"]).decode().strip().removeprefix("origin/")
            if name:
                return name
        except GitError:
            pass
        for b in BRANCHES:
            try:
                self.run(["show-ref", "--verify", "--quiet", f"refs/heads/{b}"])
                return b
            except GitError:
                continue
        raise GitError("could not detect default base branch; name one")
