"""Symbolic values as Columns with kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.functions import numbers as N
from recordflow.functions import strings as S
from recordflow.plans.symbols import NotRelational, V, const_value, inside, is_const


class Columns:
    """Columns of values over one relation. A table's fields are its columns, with their
    own types; a text's fields are the pieces of its column ``value``."""

    def __init__(self, schema: T.StructType | None, table: bool, ofs: str, fs: str, csv: bool, paragraph: bool = False):
        self.table, self.ofs, self.fs, self.csv, self.paragraph = table, ofs, fs, csv, paragraph
        self.types = [(f.name, f.dataType) for f in schema.fields if not f.name.startswith("__")] if schema is not None else []
        self.known: dict[V, tuple[Column, str]] = {}  # state and the like, as columns

    def base_field(self, n: int) -> tuple[Column, str]:
        if n > len(self.types):
            return F.lit(""), "S"
        name, kind = self.types[n - 1]
        c = F.col(f"`{name}`")
        if isinstance(kind, T.NumericType):
            return c.cast("double"), "N"
        if isinstance(kind, T.BooleanType):
            return c.cast("double"), "N"
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.coalesce(c.cast("string"), F.lit("")), "F"
        if isinstance(kind, T.ArrayType):
            return F.array_join(c.cast("array<string>"), " "), "F"
        return F.coalesce(c.cast("string"), F.lit("")), "F"

    def base_text(self, n: int) -> Column:
        name, kind = self.types[n - 1]
        c, k = self.base_field(n)
        return N.text_of_column(F.col(f"`{name}`"), kind) if k == "N" else c

    def own(self, v: V) -> tuple[Column, T.DataType] | None:
        """A field that is a table's number as its own column, uncast."""
        if not self.table or v.op not in ("field", "lastfield") or v.args[0] != V("fields", (), "A") or v.args[0] in self.known:
            return None
        n = v.args[1] if v.op == "field" else len(self.types)
        if not 1 <= n <= len(self.types):
            return None
        name, kind = self.types[n - 1]
        return (F.col(f"`{name}`"), kind) if isinstance(kind, (T.NumericType, T.BooleanType)) else None

    def key(self, v: V) -> Column:
        """What tells keys apart: a table's numbers themselves, other numbers as doubles (as
        equal numbers have equal texts), else the text."""
        if (own := self.own(v)) is not None:
            return own[0]
        c, k = self.col(v)
        return c if k == "N" else self.text(v)

    def key_text(self, v: V, key: Column) -> Column:
        """The text of a key that has been computed already."""
        if (own := self.own(v)) is not None:
            return N.text_of_column(key, own[1])
        return N.text_of_number(key) if self.col(v)[1] == "N" else key

    def array(self, v: V) -> Column:
        """An array of texts."""
        if v in self.known:
            return self.known[v][0]
        if v.op == "fields":
            if self.table:
                return F.array(*[self.base_text(i + 1) for i in range(len(self.types))])
            if self.csv:
                return S.csv_split(F.col("value"))
            if self.paragraph and self.fs not in (" ", ""):
                fs = self.fs if len(self.fs) > 1 else "[" + self.fs + "]"
                return S.split_fields(F.col("value"), "\n|" + fs, True)
            return S.split_fields(F.col("value"), self.fs)
        if v.op == "splitfields":
            return S.split_fields(self.text(v.args[0]), v.args[1], len(v.args) > 2)
        if v.op == "setfield":
            a, n, x = self.array(v.args[0]), self.number(v.args[1]).cast("int"), self.text(v.args[2])
            padded = F.concat(a, F.array_repeat(F.lit(""), F.greatest(n - F.size(a), F.lit(0))))
            return F.concat(F.slice(padded, F.lit(1), n - 1), F.array(x), F.slice(padded, n + 1, F.size(padded)))
        if v.op == "resize":
            a, n = self.array(v.args[0]), self.number(v.args[1]).cast("int")
            return F.concat(F.slice(a, F.lit(1), n), F.array_repeat(F.lit(""), F.greatest(n - F.size(a), F.lit(0))))
        if v.op == "condfields":
            return F.when(self.test(v.args[0]), self.array(v.args[1])).otherwise(self.array(v.args[2]))
        raise NotRelational(f"no array {v.op}")

    def size(self, v: V) -> Column:
        if v.op == "fields" and self.table and v not in self.known:
            return F.lit(float(len(self.types)))
        return F.size(self.array(v)).cast("double")

    def number(self, v: V) -> Column:
        c, k = self.col(v)
        if k == "N":
            return c
        if k == "W":
            return F.coalesce(c, F.lit(0.0))
        if k == "U":
            return F.lit(0.0)
        if k == "S":
            return N.number_of_text(c)
        if k == "F":
            return N.number_of_input(c)
        raise NotRelational("a value is text or number by record")

    def text(self, v: V, fmt: str = "%.6g") -> Column:
        c, k = self.col(v)
        if (own := self.own(v)) is not None and v not in self.known:
            return N.text_of_column(*own)
        if k == "N":
            return N.text_of_number(c, fmt, self.integral(v))
        if k == "W":
            return F.coalesce(N.text_of_number(c, fmt), F.lit(""))
        return F.lit("") if k == "U" else c

    def integral(self, v: V) -> bool:
        """Whether a number is known to be an integer of less than 16 digits."""
        if v.op in ("nr", "fnr", "nf", "length", "index", "subcount", "matchstart", "matchlength", "cmp", "and", "or", "not", "match", "held", "inconst", "bool"):
            return True
        if v.op == "num":
            return v.args[0] == int(v.args[0]) and abs(v.args[0]) < 1e15 if abs(v.args[0]) != float("inf") and v.args[0] == v.args[0] else False
        return v.op == "cond" and self.integral(v.args[1]) and self.integral(v.args[2])

    def test(self, v: V) -> Column:
        if v.op == "num":
            return F.lit(bool(v.args[0]))
        if v.op in ("and", "or"):
            a, b = map(self.test, v.args)
            return a & b if v.op == "and" else a | b
        if v.op == "not":
            return ~self.test(v.args[0])
        if v.op == "bool":
            c, k = self.col(v.args[0])
            if k == "M":
                raise NotRelational("a test of what is text or number by record")
            return N.truth(F.coalesce(c, F.lit(0.0)), "N") if k == "W" else N.truth(c, k)
        if v.op == "match":
            return S.matches(self.text(v.args[0]), v.args[1])
        if v.op == "cmp":
            return self.compared(*v.args)
        if v.op == "cond":
            t = self.test(v.args[0])
            return F.when(t, self.test(v.args[1])).otherwise(self.test(v.args[2]))
        if v in self.known:
            c, k = self.known[v]
            if k == "B":
                return c
        c, k = self.col(v)
        return N.truth(F.coalesce(c, F.lit(0.0)), "N") if k == "W" else N.truth(c, k)

    def compared(self, op: str, a: V, b: V) -> Column:
        if (plain := self.plain_comparison(op, a, b)) is not None:
            return plain
        x, p = self.col(a)
        y, q = self.col(b)
        if "M" in (p, q):
            raise NotRelational("a comparison of what is text or number by record")
        if "S" in (p, q):
            return N.compare_texts(op, self.text(a), self.text(b))
        if p in "NUW" and q in "NUW":
            return N.compare_numbers(op, self.number(a), self.number(b), not any(i.op == "math" for v in (a, b) for i in inside(v)))
        looks = [N.is_numeric(c) for c, k in ((x, p), (y, q)) if k == "F"]
        both = looks[0] if len(looks) == 1 else looks[0] & looks[1]
        numeric = N.compare_numbers(op, self.number(a), self.number(b), False)
        return F.when(both, numeric).otherwise(N.compare_texts(op, self.text(a), self.text(b)))

    def plain_comparison(self, op: str, a: V, b: V) -> Column | None:
        """A table's column with a constant, without casts, so that it reaches the scan."""
        if is_const(a) and not is_const(b):
            a, b, op = b, a, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
        if not (self.table and a.op == "field" and a.args[0] == V("fields", (), "A") and a.args[1] <= len(self.types) and is_const(b)):
            return None
        name, kind = self.types[a.args[1] - 1]
        c, x = F.col(f"`{name}`"), const_value(b)
        if isinstance(kind, T.IntegralType) and isinstance(x, float) and x == int(x) and abs(x) < 2**31:
            return N.compare_texts(op, c, F.lit(int(x)))
        if isinstance(kind, (T.DoubleType, T.DecimalType)) and isinstance(x, float) and x == x and abs(x) < 1e15 and (isinstance(kind, T.DoubleType) or x == int(x)):
            return N.compare_numbers(op, c, F.lit(x if isinstance(kind, T.DoubleType) else int(x)))
        if isinstance(kind, T.StringType) and type(x) is str and x and op in ("==", "!="):
            same = c.eqNullSafe(F.lit(x))
            return same if op == "==" else ~same
        return None

    def col(self, v: V) -> tuple[Column, str]:
        if v in self.known:
            c, k = self.known[v]
            return (c.cast("double"), "N") if k == "B" else (c, k)
        if is_const(v):
            x = const_value(v)
            if x is None:
                return F.lit(""), "U"
            return (F.lit(x), "N") if isinstance(x, float) else (F.lit(str(x)), v.kind)
        make = getattr(self, "c_" + v.op, None)
        if make is not None:
            return make(*v.args)
        if v.op in ("and", "or", "not", "bool", "match", "cmp"):
            return F.when(self.test(v), 1.0).otherwise(0.0), "N"
        raise NotRelational(f"{v.op} has no column here")

    def c_record(self):
        if not self.table:
            return F.col("value"), "F"
        return F.array_join(self.array(V("fields", (), "A")), self.ofs), "F"

    def c_field(self, fields, n):
        if fields.op == "fields" and self.table and fields not in self.known:
            return self.base_field(n)
        return F.coalesce(F.get(self.array(fields), F.lit(n - 1)), F.lit("")), "F"

    def c_lastfield(self, fields):
        if fields.op == "fields" and self.table:
            return self.base_field(len(self.types))
        return F.coalesce(F.try_element_at(self.array(fields), F.lit(-1)), F.lit("")), "F"

    def c_dynfield(self, fields, record, i):
        n = self.number(i).cast("int")
        bad = F.raise_error(F.lit("bad field number")).cast("string")
        return F.when(n < 0, bad).when(n == 0, self.text(record)).otherwise(F.coalesce(F.get(self.array(fields), n - 1), F.lit(""))), "F"

    def c_nf(self, fields):
        return self.size(fields), "N"

    def c_joinfields(self, fields, ofs):
        return F.array_join(self.array(fields), ofs), "F"

    def c_text(self, v, fmt):
        return self.text(v, fmt), "S"

    def c_tonum(self, v):
        return self.number(v), "N"

    def c_concat(self, a, b):
        return F.concat(self.text(a), self.text(b)), "S"

    def c_arith(self, op, a, b):
        x, y = self.number(a), self.number(b)
        if op == "/":
            return (x / y if is_const(b) and const_value(b) else N.divided(x, y)), "N"
        if op == "%":
            return (x % y if is_const(b) and const_value(b) else N.remainder(x, y)), "N"
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "^": lambda: F.pow(x, y)}[op](), "N"

    def c_neg(self, v):
        return -self.number(v), "N"

    def c_cond(self, t, a, b):
        x, p = self.col(a)
        y, q = self.col(b)
        test = self.test(t)
        if p == q:
            return F.when(test, x).otherwise(y), p
        if {p, q} <= {"N", "U", "W"}:
            unset = F.lit(None).cast("double")
            return F.when(test, unset if p == "U" else x).otherwise(unset if q == "U" else y), "W"
        kind = "S" if {p, q} == {"S", "U"} else "F" if {p, q} == {"F", "U"} else "M"
        return F.when(test, self.text(a)).otherwise(self.text(b)), kind

    def c_length(self, v):
        return F.length(self.text(v)).cast("double"), "N"

    def c_tolower(self, v):
        return S.tolower(self.text(v)), "S"

    def c_toupper(self, v):
        return S.toupper(self.text(v)), "S"

    def c_substr(self, s, m, n=None):
        return S.substr(self.text(s), self.number(m), None if n is None else self.number(n)), "S"

    def c_index(self, s, t):
        return S.index(self.text(s), self.text(t)), "N"

    def c_math(self, name, args):
        x = [self.number(a) for a in args]
        if name in ("and", "or", "xor"):
            a, b = map(N.to_long, x)
            return {"and": a.bitwiseAND, "or": a.bitwiseOR, "xor": a.bitwiseXOR}[name](b).cast("double"), "N"
        if name in ("lshift", "rshift"):
            return N.shifted(x[0], x[1], name == "lshift"), "N"
        if name == "atan2":
            return (F.atan2(x[0], x[1]) if len(x) > 1 else F.lit(1.0)), "N"
        return {"sin": F.sin, "cos": F.cos, "exp": N.exponential, "log": N.logarithm, "sqrt": N.square_root, "int": N.truncated}[name](x[0]), "N"

    def c_sprintf(self, fmt, args, convfmt):
        given = []
        for a in args:
            c, k = self.col(a)
            own = self.own(a)
            given.append((self.text(a), "S", None) if k in "UM" else (self.number(a), "N", None) if k == "W" else (c, k, N.text_of_column(*own) if own is not None and k == "N" else None))
        return S.sprintf(fmt, given, convfmt), "S"

    def c_strftime(self, fmt, at):
        return S.strftime(fmt, self.number(at)), "S"

    def c_systime(self):
        return F.unix_timestamp().cast("double"), "N"

    def c_rand(self):
        return F.rand(0), "N"

    def c_subtext(self, s, pattern, repl, every):
        return S.substitute(self.text(s), pattern, repl, every)[0], "S"

    def c_subcount(self, s, pattern, repl, every):
        return S.substitute(self.text(s), pattern, repl, every)[1], "N"

    def c_matchstart(self, s, pattern):
        return S.match(self.text(s), pattern)[0], "N"

    def c_matchlength(self, s, pattern):
        return S.match(self.text(s), pattern)[1], "N"

    def c_filename(self):
        return F.col("__file"), "S"

    def c_rt(self):
        return F.col("rt"), "S"

    def c_itemfield(self, fields):
        return F.col("__item"), "F"

    def c_item(self, first):
        return (F.col("__at") + first).cast("double"), "N"




