"""Operator-precedence parser."""

from __future__ import annotations

from recordflow.lang.lexer import BUILTINS, Token, tokens
from recordflow.lang.nodes import (
    Assign,
    Binary,
    Block,
    Call,
    Cond,
    Delete,
    Do,
    Field,
    ForIn,
    Function,
    Getline,
    Group,
    If,
    In,
    Index,
    Jump,
    Leave,
    Loop,
    Match,
    Num,
    Print,
    ProgramError,
    Regex,
    Rule,
    Step,
    Str,
    Tree,
    Unary,
    Var,
)

#: Binary operators by how tightly they bind, and whether newlines may follow.
LEVELS = {"||": 3, "&&": 4, "in": 5, "~": 6, "!~": 6, "<": 7, "<=": 7, "==": 7, "!=": 7, ">": 7, ">=": 7, "": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
ASSIGN = {"=": "", "+=": "+", "-=": "-", "*=": "*", "/=": "/", "%=": "%", "^=": "^", "**=": "^"}
CONCAT, UNARY, POWER = 8, 11, 12


class Parser:
    def __init__(self, source: str):
        self.tokens, self.at = tokens(source), 0
        self.printing = False  # an unparenthesised > belongs to the statement

    # -- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def sees(self, *texts: str) -> bool:
        t = self.now
        return t.kind in ("symbol", "keyword") and t.text in texts

    def take(self, text: str) -> Token:
        if not self.sees(text):
            found = self.now.text.strip() or "the end"
            raise ProgramError(f"line {self.now.line}: {text!r} expected, not {found!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def took(self, *texts: str) -> bool:
        if self.sees(*texts):
            self.at += 1
            return True
        return False

    def newlines(self) -> None:
        while self.now.kind == "newline":
            self.at += 1

    def breaks(self) -> None:
        while self.now.kind == "newline" or self.sees(";"):
            self.at += 1

    # -- rules

    def program(self) -> Tree:
        tree = Tree()
        self.breaks()
        while self.now.kind != "end":
            if self.took("function"):
                f = self.function()
                if f.name in tree.functions:
                    raise ProgramError(f"function {f.name} is defined twice")
                tree.functions[f.name] = f
            else:
                tree.rules.append(self.rule())
            self.breaks()
        return tree

    def function(self) -> Function:
        name = self.now.text
        if self.now.kind not in ("call", "name"):
            raise ProgramError(f"line {self.now.line}: a function needs a name of its own, not {name!r}")
        self.at += 1
        self.take("(")
        params: list[str] = []
        self.newlines()
        while not self.sees(")"):
            if self.now.kind != "name":
                raise ProgramError(f"line {self.now.line}: a parameter's name expected")
            params.append(self.now.text)
            self.at += 1
            self.newlines()
            if not self.took(","):
                break
            self.newlines()
        self.take(")")
        self.newlines()
        return Function(name, tuple(params), self.block())

    def rule(self) -> Rule:
        if self.sees("{"):
            return Rule("always", None, None, self.block())
        if self.sees("BEGIN", "END", "BEGINFILE", "ENDFILE"):
            kind = self.now.text
            self.at += 1
            self.newlines()
            return Rule(kind, None, None, self.block())
        pattern, until = self.expression(), None
        if self.took(","):
            self.newlines()
            until = self.expression()
        at = self.at
        self.newlines()
        if not self.sees("{"):
            self.at = at
            return Rule("range" if until else "when", pattern, until, None)
        return Rule("range" if until else "when", pattern, until, self.block())

    # -- statements

    def block(self) -> Block:
        self.take("{")
        body = []
        self.breaks()
        while not self.sees("}"):
            body.append(self.statement())
            self.breaks()
        self.take("}")
        return Block(tuple(body))

    def body(self) -> object:
        self.newlines()
        if self.took(";"):
            return Block(())
        return self.block() if self.sees("{") else self.statement()

    def ended(self) -> bool:
        return self.now.kind in ("newline", "end") or self.sees(";", "}")

    def finish(self, statement):
        if not self.ended() and not self.sees("else"):
            raise ProgramError(f"line {self.now.line}: unexpected {self.now.text!r}")
        self.took(";")
        return statement

    def statement(self) -> object:
        t = self.now
        if self.sees("{"):
            return self.block()
        if t.kind == "keyword":
            make = getattr(self, f"do_{t.text}", None)
            if make and t.text != "getline":
                self.at += 1
                return make()
        return self.finish(self.simple())

    def simple(self) -> object:
        e = self.expression()
        if isinstance(e, (Num, Str)):
            raise ProgramError(f"line {self.now.line}: a constant is no statement")
        return Do(e)

    def test(self) -> object:
        self.take("(")
        self.newlines()
        e = self.whole()
        self.newlines()
        self.take(")")
        return e

    def whole(self) -> object:
        """An expression in which > compares."""
        before, self.printing = self.printing, False
        e = self.expression()
        self.printing = before
        return e

    def do_if(self) -> If:
        test = self.test()
        yes = self.body()
        at = self.at
        self.breaks()
        if self.took("else"):
            return If(test, yes, self.body())
        self.at = at
        return If(test, yes, None)

    def do_while(self) -> Loop:
        test = self.test()
        return Loop(None, test, None, self.body())

    def do_do(self) -> Loop:
        body = self.body()
        self.breaks()
        self.take("while")
        return self.finish(Loop(None, self.test(), None, body, False))

    def do_for(self) -> object:
        self.take("(")
        self.newlines()
        a, b, c, d = self.tokens[self.at : self.at + 4]
        if a.kind == "name" and b.text == "in" and b.kind == "keyword" and c.kind == "name" and d.text == ")":
            self.at += 4
            return ForIn(a.text, c.text, self.body())
        parts = []
        for end in (";", ";", ")"):
            self.newlines()
            parts.append(None if self.sees(end) else self.simple() if end == ")" or not parts else self.whole())
            self.newlines()
            self.take(end)
        return Loop(*parts, self.body())

    def do_print(self, formatted: bool = False) -> Print:
        args: list = []
        self.printing = True
        if self.sees("(") and (listed := self.parenthesised()):
            args = listed
        elif not self.ended() and not self.sees(">", ">>", "|"):
            args = [self.expression()]
            while self.took(","):
                self.newlines()
                args.append(self.expression())
        mode, to = "", None
        if self.sees(">", ">>", "|"):
            mode = self.now.text
            self.at += 1
            to = self.binary(CONCAT)
        self.printing = False
        return self.finish(Print(tuple(args), formatted, mode, to))

    def do_printf(self) -> Print:
        p = self.do_print(True)
        if not p.args:
            raise ProgramError(f"line {self.now.line}: printf needs a format")
        return p

    def parenthesised(self) -> list | None:
        """The arguments of print (a, b), if the parentheses hold them all."""
        at = self.at
        self.take("(")
        self.newlines()
        before, self.printing = self.printing, False
        args = []
        if not self.sees(")"):
            args.append(self.expression())
            self.newlines()
            while self.took(","):
                self.newlines()
                args.append(self.expression())
                self.newlines()
        self.printing = before
        self.take(")")
        if self.ended() or self.sees(">", ">>", "|"):
            return args
        self.at = at
        return None

    def do_next(self):
        return self.finish(Jump("next"))

    def do_nextfile(self):
        return self.finish(Jump("nextfile"))

    def do_break(self):
        return self.finish(Jump("break"))

    def do_continue(self):
        return self.finish(Jump("continue"))

    def do_exit(self):
        return self.finish(Leave("exit", None if self.ended() else self.expression()))

    def do_return(self):
        return self.finish(Leave("return", None if self.ended() else self.expression()))

    def do_delete(self) -> Delete:
        name = self.now.text
        if self.now.kind != "name":
            raise ProgramError(f"line {self.now.line}: delete needs an array")
        self.at += 1
        return self.finish(Delete(name, self.subscript() if self.sees("[") else None))

    # -- expressions

    def expression(self) -> object:
        left = self.binary(LEVELS["||"])
        if self.sees(*ASSIGN) and isinstance(left, (Var, Field, Index)):
            op = ASSIGN[self.now.text]
            self.at += 1
            self.newlines()
            return Assign(op, left, self.expression())
        at = self.at
        self.newlines()
        if self.took("?"):
            self.newlines()
            yes = self.expression()
            self.newlines()
            self.take(":")
            self.newlines()
            return Cond(left, yes, self.expression())
        self.at = at
        return left

    def operator(self) -> str | None:
        """The binary operator that stands here: "" where the next thing is joined."""
        t = self.now
        if t.kind == "symbol":
            if t.text == "|" or t.text in (">", ">>", ">=") and self.printing:
                return None
            if t.text in LEVELS:
                return t.text
            return "" if t.text in ("$", "!", "(", "++", "--") else None
        if t.kind == "keyword":
            return "in" if t.text == "in" else None
        return "" if t.kind in ("number", "string", "regex", "name", "call", "builtin") else None

    def binary(self, least: int) -> object:
        left = self.unary()
        while True:
            if self.sees(*ASSIGN) and isinstance(left, (Var, Field, Index)) and least > 2:
                # an assignment as a right operand takes all that follows, as in a && b = c
                op = ASSIGN[self.now.text]
                self.at += 1
                self.newlines()
                return Assign(op, left, self.expression())
            op = self.operator()
            if op is None or LEVELS[op] < least:
                return left
            level = LEVELS[op]
            if op:
                self.at += 1
                self.newlines()
            if op == "in":
                keys = tuple(left.value) if isinstance(left, Group) and isinstance(left.value, list) else (left,)
                left = In(keys, self.now.text)
                self.at += 1
            else:
                right = self.binary(level + 1)
                left = Match(op == "!~", left, right) if op in ("~", "!~") else Binary(op, left, right)

    def unary(self) -> object:
        if self.sees("-", "+", "!"):
            op = self.now.text
            self.at += 1
            self.newlines()
            return Unary(op, self.unary())
        return self.power()

    def power(self) -> object:
        left = self.term()
        if self.sees("^", "**"):
            self.at += 1
            self.newlines()
            return Binary("^", left, self.unary())
        return left

    def term(self) -> object:
        if self.sees("++", "--"):
            delta = 1 if self.now.text == "++" else -1
            self.at += 1
            self.newlines()
            return Step(delta, True, self.lvalue(self.primary()))
        left = self.primary()
        if self.sees("++", "--") and isinstance(left, (Var, Field, Index)):
            delta = 1 if self.now.text == "++" else -1
            self.at += 1
            left = Step(delta, False, left)
        while self.sees("|") and self.ahead("getline"):
            self.at += 2
            left = Getline("command", left, self.getline_target())
        return left

    def ahead(self, word: str) -> bool:
        t = self.tokens[self.at + 1]
        return t.kind == "keyword" and t.text == word

    def lvalue(self, node):
        if not isinstance(node, (Var, Field, Index)):
            raise ProgramError(f"line {self.now.line}: nothing to assign to")
        return node

    def getline_target(self):
        if self.sees("$"):
            return self.primary()
        if self.now.kind == "name":
            return self.primary()
        return None

    def subscript(self) -> tuple:
        self.take("[")
        keys = self.listed("]")
        return tuple(keys)

    def listed(self, end: str) -> list:
        before, self.printing = self.printing, False
        out = []
        self.newlines()
        while not self.sees(end):
            out.append(self.expression())
            self.newlines()
            if not self.took(","):
                break
            self.newlines()
        self.take(end)
        self.printing = before
        return out

    def primary(self) -> object:
        t = self.now
        self.at += 1
        if t.kind == "number":
            return Num(float(t.text))
        if t.kind == "string":
            return Str(t.text)
        if t.kind == "regex":
            return Regex(t.text)
        if t.kind == "builtin":
            if self.sees("("):
                self.at += 1
                return Call(t.text, tuple(self.listed(")")), True)
            if t.text == "length":
                return Call("length", (), True)
            raise ProgramError(f"line {t.line}: {t.text} needs arguments")
        if t.kind == "call":
            self.take("(")
            return Call(t.text, tuple(self.listed(")")), False)
        if t.kind == "name":
            return Index(t.text, self.subscript()) if self.sees("[") else Var(t.text)
        if t.kind == "keyword" and t.text == "getline":
            target = self.getline_target()
            if self.took("<"):
                self.newlines()
                return Getline("file", self.binary(CONCAT + 1), target)
            return Getline("main", None, target)
        if t.kind == "symbol" and t.text == "$":
            if self.sees("++", "--"):
                delta = 1 if self.now.text == "++" else -1
                self.at += 1
                return Field(Step(delta, True, self.lvalue(self.primary())))
            if self.sees("-", "+", "!"):
                return Field(self.unary())
            inner = self.primary()
            if isinstance(inner, Index) and self.sees("++", "--"):
                delta = 1 if self.now.text == "++" else -1
                self.at += 1
                inner = Step(delta, False, inner)
            return Field(inner)
        if t.kind == "symbol" and t.text == "(":
            inside = self.listed(")")
            if len(inside) == 1:
                return Group(inside[0])
            if len(inside) > 1 and self.sees("in"):
                return Group(inside)
        found = t.text.strip() or "the end"
        raise ProgramError(f"line {t.line}: unexpected {found!r}")


def parse(source: str) -> Tree:
    return Parser(source).program()


__all__ = ["BUILTINS", "Parser", "parse"]
