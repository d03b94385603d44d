"""Scopes of a Python syntax tree: which binding each name in it means."""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
MODULE = 0


@dataclass
class Scope:
    """``bound`` has the first line that binds each name here; ``outer`` the names declared global (True) or nonlocal."""

    kind: str
    parent: int
    bound: dict[str, int] = field(default_factory=dict)
    outer: dict[str, bool] = field(default_factory=dict)


class Scopes:
    """All scopes of a module, numbered from 0 for the module itself, and the names and attributes used in each.

    ``home`` tells in which scope a definition or an import binds its names. The tree is walked with a stack of its own,
    so expressions of any depth are read.
    """

    def __init__(self, tree: ast.Module):
        self.scopes = [Scope("module", MODULE)]
        self.home: dict[ast.AST, int] = {}
        self.names: list[tuple[str, bool, int, int]] = []  # name, loaded, line, scope
        self.attributes: list[tuple[str, str | None, int, int]] = []  # attribute, name at the root, line, scope
        self._waiting: list[tuple[ast.AST, int]] = [(tree, MODULE)]
        while self._waiting:
            self._visit(*self._waiting.pop())

    def meaning(self, name: str, scope: int, line: int | None = None) -> int:
        """The scope whose binding ``name`` means in ``scope``; the module's where no inner one binds it.

        A class body is visible from itself alone, and there a name read up to the line that first binds it (``line``)
        still means the outer one.
        """
        at, direct = scope, True
        while at != MODULE:
            here = self.scopes[at]
            if here.outer.get(name):
                return MODULE
            if name in here.bound and name not in here.outer:
                if here.kind != "class" or (direct and (line is None or line > here.bound[name])):
                    return at
            at, direct = here.parent, False
        return MODULE

    def uses(self) -> list[tuple[str, bool, int, str | None, int]]:
        """(name, dotted, line, base, scope) of every name and, dotted, every attribute, once per line.

        ``scope`` is that of the binding which the name means, for an attribute that of ``base``, the name at the root
        of the expression in front of it, if there is one.
        """
        found = {(n, False, line, None, self.meaning(n, s, line if loaded else None)) for n, loaded, line, s in self.names}
        for attribute, base, line, scope in self.attributes:
            found.add((attribute, True, line, base, MODULE if base is None else self.meaning(base, scope, line)))
        return sorted(found, key=lambda use: (*use[:3], use[3] or "", use[4]))

    def _open(self, kind: str, parent: int) -> int:
        self.scopes.append(Scope(kind, parent))
        return len(self.scopes) - 1

    def _bind(self, scope: int, name: str | None, line: int) -> None:
        if name is not None:
            bound = self.scopes[scope].bound
            bound[name] = min(line, bound.get(name, line))

    def _later(self, scope: int, *nodes: ast.AST | None) -> None:
        self._waiting += [(node, scope) for node in reversed(nodes) if node is not None]

    def _typed(self, node: ast.AST, scope: int) -> int:
        """The scope of a definition's type parameters, or ``scope`` where it has none."""
        parameters = getattr(node, "type_params", [])
        if not parameters:
            return scope
        inner = self._open("types", scope)
        for parameter in parameters:
            self._bind(inner, parameter.name, parameter.lineno)
            self._later(inner, *ast.iter_child_nodes(parameter))
        return inner

    def _function(self, node: ast.AST, scope: int) -> None:
        arguments = node.args
        self._later(scope, *arguments.defaults, *arguments.kw_defaults)
        outside = self._typed(node, scope)
        inner = self._open("function", outside)
        every = [*arguments.posonlyargs, *arguments.args, *arguments.kwonlyargs, arguments.vararg, arguments.kwarg]
        for argument in filter(None, every):
            self._bind(inner, argument.arg, argument.lineno)
            self._later(outside, argument.annotation)
        if isinstance(node, ast.Lambda):
            self._later(inner, node.body)
        else:
            self._later(outside, node.returns)
            self._later(inner, *node.body)

    def _visit(self, node: ast.AST, scope: int) -> None:
        if isinstance(node, ast.Name):
            loaded = isinstance(node.ctx, ast.Load)
            if not loaded:
                self._bind(scope, node.id, node.lineno)
            self.names.append((node.id, loaded, node.lineno, scope))
        elif isinstance(node, ast.Attribute):
            root = node.value
            while isinstance(root, ast.Attribute | ast.Call | ast.Subscript):
                root = root.func if isinstance(root, ast.Call) else root.value
            base = root.id if isinstance(root, ast.Name) else None
            self.attributes.append((node.attr, base, node.end_lineno, scope))
            self._later(scope, node.value)
        elif isinstance(node, _FUNCTIONS):
            self.home[node] = scope
            self._bind(scope, node.name, node.lineno)
            self._later(scope, *node.decorator_list)
            self._function(node, scope)
        elif isinstance(node, ast.Lambda):
            self._function(node, scope)
        elif isinstance(node, ast.ClassDef):
            self.home[node] = scope
            self._bind(scope, node.name, node.lineno)
            self._later(scope, *node.decorator_list)
            outside = self._typed(node, scope)
            self._later(outside, *node.bases, *node.keywords)
            self._later(self._open("class", outside), *node.body)
        elif isinstance(node, _COMPREHENSIONS):
            inner = self._open("comprehension", scope)
            for n, part in enumerate(node.generators):
                self._later(inner, part.target, *part.ifs)
                self._later(inner if n else scope, part.iter)
            self._later(inner, *([node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]))
        elif isinstance(node, ast.NamedExpr):
            owner = scope
            while self.scopes[owner].kind == "comprehension":
                owner = self.scopes[owner].parent
            self._later(owner, node.target)
            self._later(scope, node.value)
        elif isinstance(node, ast.Global | ast.Nonlocal):
            for name in node.names:
                self.scopes[scope].outer[name] = isinstance(node, ast.Global)
                self.names.append((name, False, node.lineno, scope))
        elif isinstance(node, ast.Import | ast.ImportFrom):
            self.home[node] = scope
            for alias in node.names:
                self._bind(scope, alias.asname or alias.name.partition(".")[0], node.lineno)
        elif isinstance(node, ast.TypeAlias):
            self._later(scope, node.name)
            self._later(self._typed(node, scope), node.value)
        else:
            if isinstance(node, ast.ExceptHandler | ast.MatchAs | ast.MatchStar):
                self._bind(scope, node.name, node.lineno)
            elif isinstance(node, ast.MatchMapping):
                self._bind(scope, node.rest, node.lineno)
            self._later(scope, *ast.iter_child_nodes(node))
