"""Fingerprints of stage code: syntax trees, so that comments and layout don't count."""

from __future__ import annotations

import ast
import hashlib
import inspect
from collections.abc import Callable, Iterable
from pathlib import Path

TRIES = 3
Function = ast.FunctionDef | ast.AsyncFunctionDef


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _functions(tree: ast.AST, scope: str = "") -> Iterable[tuple[str, Function]]:
    """(qualified name, node) of every function of a module, as Python names them."""
    for node in ast.iter_child_nodes(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield scope + node.name, node
            yield from _functions(node, f"{scope}{node.name}.<locals>.")
        elif isinstance(node, ast.ClassDef):
            yield from _functions(node, f"{scope}{node.name}.")
        else:
            yield from _functions(node, scope)


class Sources:
    """What one observation reads: each file once, and as it was in one moment."""

    def __init__(self) -> None:
        self._trees: dict[Path, ast.Module] = {}

    def tree(self, path: Path) -> ast.Module:
        """The file's syntax tree, from a read during which the file stayed the same; its own encoding holds."""
        path = path.resolve()
        if path not in self._trees:
            for _ in range(TRIES):
                before = path.stat()
                data = path.read_bytes()
                after = path.stat()
                if (before.st_ino, before.st_size, before.st_mtime_ns) == (after.st_ino, after.st_size, after.st_mtime_ns) and len(data) == after.st_size:
                    self._trees[path] = ast.parse(data)
                    break
            else:
                raise RuntimeError(f"{path} changes while it is read")
        return self._trees[path]

    def locate(self, func: Callable) -> tuple[Path, Function]:
        """The callable's file and its own node: by qualified name, and by line where that isn't enough."""
        func = inspect.unwrap(func)
        file = inspect.getsourcefile(func)
        if not file:
            raise ValueError(f"no Python source file of stage {func.__qualname__}")
        path = Path(file)
        found = [node for name, node in _functions(self.tree(path)) if name == func.__qualname__]
        if len(found) > 1:
            found = [n for n in found if func.__code__.co_firstlineno in (n.lineno, *(d.lineno for d in n.decorator_list))]
        if len(found) != 1:
            raise ValueError(f"stage {func.__qualname__} isn't one function of {path.name}: {len(found)} candidates")
        return path, found[0]


def callable_digest(func: Callable, sources: Sources | None = None) -> str:
    """Where the callable lives, and its own tree: decorators, signature and docstring too."""
    _, node = (sources or Sources()).locate(func)
    return _digest(f"{func.__module__}:{func.__qualname__}:{ast.dump(node)}")


def residual_digest(func: Callable, staged: Iterable[Callable], sources: Sources | None = None) -> str:
    """The rest of the callable's file: all but the very functions that are stages."""
    sources = sources or Sources()
    path, own = sources.locate(func)
    gone = {id(own)}
    for other in staged:
        file = inspect.getsourcefile(inspect.unwrap(other))
        if file and Path(file).resolve() == path.resolve():
            gone.add(id(sources.locate(other)[1]))

    def dump(node: ast.AST) -> str:
        parts = []
        for name, value in ast.iter_fields(node):
            values = value if isinstance(value, list) else [value]
            shown = [dump(v) if isinstance(v, ast.AST) else repr(v) for v in values if id(v) not in gone]
            parts.append(f"{name}=[{','.join(shown)}]")
        return f"{type(node).__name__}({','.join(parts)})"

    return _digest(dump(sources.tree(path)))


def _members(roots: tuple[str, ...]) -> list[tuple[str, Path]]:
    """(name below its root, file) of declared files; folders are walked in order, links are refused."""
    found = []
    for root in roots:
        path = Path(root)
        files = [path] if path.is_file() else sorted(path.rglob("*.py"))
        if not path.exists() or not files:
            raise FileNotFoundError(f"declared source {root!r} has no Python files")
        for f in files:
            if f.is_symlink():
                raise ValueError(f"a declared source is a link: {f}")
            found.append((f.name if path.is_file() else str(f.relative_to(path)), f))
    return found


def files_digest(members: Iterable[tuple[str, Path]], sources: Sources | None = None) -> str:
    sources = sources or Sources()
    return _digest("\n".join(f"{name}:{ast.dump(sources.tree(f))}" for name, f in members))


def observe(func: Callable, staged: Iterable[Callable], sources: tuple[str, ...], review_sources: tuple[str, ...], session: Sources | None = None) -> tuple[str, str]:
    """(rerun, review): a change of the first reruns, of the second asks. A file in both is the first's."""
    session = session or Sources()
    if twice := {str(Path(s).resolve()) for s in sources} & {str(Path(s).resolve()) for s in review_sources}:
        raise ValueError(f"a source has two policies: {', '.join(sorted(twice))}")
    own = _members(sources)
    taken = {f.resolve() for _, f in own}
    asked = [(name, f) for name, f in _members(review_sources) if f.resolve() not in taken]
    rerun = callable_digest(func, session) + (files_digest(own, session) if own else "")
    review = residual_digest(func, staged, session) + (files_digest(asked, session) if asked else "")
    return _digest(rerun), _digest(review)
