"""A small project in all five languages, as rows of files: what the extraction queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_sha
from ..sources import files as S

FILES = {
    "shop/schema.sql": """CREATE TABLE users (
  id INTEGER PRIMARY KEY,
  email TEXT NOT NULL
);
CREATE TABLE orders (id INTEGER, user_id INTEGER REFERENCES users(id), total REAL);
""",
    "shop/models.py": '''"""Tables as classes."""
from sqlalchemy import Column


class Base:
    pass


class User(Base):
    """A customer."""
    __tablename__ = "users"
    email = Column()

    def domain(self):
        # NOTE: addresses have one sign
        return split_address(self.email)


def split_address(address):
    return address.split("@")
''',
    "shop/store.py": '''import shop.models
from shop import mailer


def save(db, email):
    """Store a user."""
    db.execute("INSERT INTO users (email) VALUES (?)", email)
    return latest(db)


def latest(db):
    return db.execute("SELECT users.email FROM users JOIN orders ON orders.user_id = users.id")


def sign_up(form):
    return save(form.db, form.email)
''',
    "shop/broken.py": '''def works():
    return save(1, 2)


def broken(:
    return 3


def after():
    return works()
''',
    "web/Account.java": """package web;

import java.util.List;
import web.Entity;

/** An account. */
@Entity
@Table(name = "users")
public class Account extends Base implements Named {
    private String email;

    /** Its name. */
    public String name() {
        return format(email);
    }

    static String format(String text) {
        return text.trim();
    }
}

interface Named {
    String name();
}

class Base {
}
""",
    "svc/server.go": """package svc

import "fmt"

// Server answers.
type Server struct {
    name string
}

type Runner interface {
    Run()
}

// Run starts it.
func (s *Server) Run() {
    s.log("up")
}

func (s *Server) log(text string) {
    fmt.Println(text)
}

func New() *Server {
    return &Server{}
}
""",
    "ui/app.ts": """import { helper } from "./helper";

export interface Shape { area(): number; }

export class Circle extends Base implements Shape {
  area(): number { return this.square(2); }
  square(x: number) { return helper(x); }
}

export class Base {}

export const draw = (c: Circle) => c.area();
""",
    "ui/helper.ts": """export function helper(x: number): number { return x * x; }
""",
}


# What the project holds, worked out by the rules of the languages, as rows of SQL. Nodes are (language,
# kind, qualified name, first line, last line, signature, docstring); references (language, what, from, to, own receiver).
NODES = """
  ('go', 'module', 'svc.server', 1, 26, '', ''),
  ('go', 'class', 'svc.Server', 6, 8, 'Server struct', ''),
  ('go', 'interface', 'svc.Runner', 10, 12, 'Runner interface', ''),
  ('go', 'method', 'svc.Server.Run', 15, 17, 'func (s *Server) Run()', ''),
  ('go', 'method', 'svc.Server.log', 19, 21, 'func (s *Server) log(text string)', ''),
  ('go', 'function', 'svc.New', 23, 25, 'func New() *Server', ''),
  ('java', 'module', 'web.Account', 1, 28, '', ''),
  ('java', 'class', 'web.Account', 7, 20, '@Entity', 'An account.'),
  ('java', 'method', 'web.Account.name', 13, 15, 'public String name()', 'Its name.'),
  ('java', 'method', 'web.Account.format', 17, 19, 'static String format(String text)', ''),
  ('java', 'interface', 'web.Named', 22, 24, 'interface Named', ''),
  ('java', 'method', 'web.Named.name', 23, 23, 'String name();', ''),
  ('java', 'class', 'web.Base', 26, 27, 'class Base', ''),
  ('python', 'module', 'shop.broken', 1, 11, '', ''),
  ('python', 'function', 'shop.broken.works', 1, 2, 'def works()', ''),
  ('python', 'function', 'shop.broken.after', 9, 10, 'def after()', ''),
  ('python', 'module', 'shop.models', 1, 21, '', 'Tables as classes.'),
  ('python', 'class', 'shop.models.Base', 5, 6, 'class Base', ''),
  ('python', 'class', 'shop.models.User', 9, 16, 'class User(Base)', 'A customer.'),
  ('python', 'method', 'shop.models.User.domain', 14, 16, 'def domain(self)', ''),
  ('python', 'function', 'shop.models.split_address', 19, 20, 'def split_address(address)', ''),
  ('python', 'rationale', 'shop/models.py::rationale@15', 15, 15, '', 'NOTE: addresses have one sign'),
  ('python', 'module', 'shop.store', 1, 17, '', ''),
  ('python', 'function', 'shop.store.save', 5, 8, 'def save(db, email)', 'Store a user.'),
  ('python', 'function', 'shop.store.latest', 11, 12, 'def latest(db)', ''),
  ('python', 'function', 'shop.store.sign_up', 15, 16, 'def sign_up(form)', ''),
  ('sql', 'table', 'users', 1, 1, 'TABLE users (id INTEGER, email TEXT)', ''),
  ('sql', 'column', 'users.id', 1, 1, 'id INTEGER', ''),
  ('sql', 'column', 'users.email', 1, 1, 'email TEXT', ''),
  ('sql', 'table', 'orders', 5, 5, 'TABLE orders (id INTEGER, user_id INTEGER, total REAL)', ''),
  ('sql', 'column', 'orders.id', 5, 5, 'id INTEGER', ''),
  ('sql', 'column', 'orders.user_id', 5, 5, 'user_id INTEGER', ''),
  ('sql', 'column', 'orders.total', 5, 5, 'total REAL', ''),
  ('ts', 'module', 'ui.app', 1, 13, '', ''),
  ('ts', 'interface', 'ui.app.Shape', 3, 3, 'interface Shape { area(): number; }', ''),
  ('ts', 'class', 'ui.app.Circle', 5, 8, 'class Circle extends Base implements Shape', ''),
  ('ts', 'method', 'ui.app.Circle.area', 6, 6, 'area(): number { return this.square(2); }', ''),
  ('ts', 'method', 'ui.app.Circle.square', 7, 7, 'square(x: number) { return helper(x); }', ''),
  ('ts', 'class', 'ui.app.Base', 10, 10, 'class Base {}', ''),
  ('ts', 'function', 'ui.app.draw', 12, 12, 'draw = (c: Circle) => c.area()', ''),
  ('ts', 'module', 'ui.helper', 1, 2, '', ''),
  ('ts', 'function', 'ui.helper.helper', 1, 1, 'function helper(x: number): number { return x * x; }', '')"""

REFERENCES = """
  ('go', 'call', 'svc.Server.Run#15', 'log', True),
  ('go', 'call', 'svc.Server.log#19', 'Println', False),
  ('go', 'import', 'svc.server', 'fmt', NULL),
  ('go', 'owns', 'svc.Server.Run#15', 'svc.Server', NULL),
  ('go', 'owns', 'svc.Server.log#19', 'svc.Server', NULL),
  ('java', 'base', 'web.Account#7', 'Base', NULL),
  ('java', 'base', 'web.Account#7', 'Named', NULL),
  ('java', 'call', 'web.Account.format#17', 'trim', False),
  ('java', 'call', 'web.Account.name#13', 'format', True),
  ('java', 'import', 'web.Account', 'java.util.List', NULL),
  ('java', 'import', 'web.Account', 'web.Entity', NULL),
  ('java', 'orm', 'web.Account#7', 'users', NULL),
  ('python', 'attr', 'shop.models.User.domain#14', 'email', NULL),
  ('python', 'base', 'shop.models.User#9', 'Base', NULL),
  ('python', 'call', 'shop.broken.after#9', 'works', False),
  ('python', 'call', 'shop.broken.works#1', 'save', False),
  ('python', 'call', 'shop.models.User.domain#14', 'split_address', False),
  ('python', 'call', 'shop.models.split_address#19', 'split', False),
  ('python', 'call', 'shop.store.latest#11', 'execute', False),
  ('python', 'call', 'shop.store.save#5', 'execute', False),
  ('python', 'call', 'shop.store.save#5', 'latest', False),
  ('python', 'call', 'shop.store.sign_up#15', 'save', False),
  ('python', 'import', 'shop.models', 'sqlalchemy', NULL),
  ('python', 'import', 'shop.store', 'shop', NULL),
  ('python', 'orm', 'shop.models.User#9', 'users', NULL),
  ('python', 'sql', 'shop.store.latest#11', 'SELECT users.email FROM users JOIN orders ON orders.user_id = users.id', NULL),
  ('python', 'sql', 'shop.store.save#5', 'INSERT INTO users (email) VALUES (?)', NULL),
  ('python', 'warning', 'syntax errors in shop/broken.py; its graph may be partial (invalid syntax (<unknown>, line 5))', NULL, NULL),
  ('sql', 'fk', 'table.orders.user_id', 'users', NULL),
  ('ts', 'base', 'ui.app.Circle#5', 'Base', NULL),
  ('ts', 'base', 'ui.app.Circle#5', 'Shape', NULL),
  ('ts', 'call', 'ui.app.Circle.area#6', 'square', True),
  ('ts', 'call', 'ui.app.Circle.square#7', 'helper', False),
  ('ts', 'call', 'ui.app.draw#12', 'area', False),
  ('ts', 'import', 'ui.app', './helper', NULL)"""

EDGES = """
  ('CALLS', 'shop.broken.after', 'shop.broken.works', 'INFERRED'),
  ('CALLS', 'shop.broken.works', 'shop.store.save', 'INFERRED'),
  ('CALLS', 'shop.models.User.domain', 'shop.models.split_address', 'INFERRED'),
  ('CALLS', 'shop.store.save', 'shop.store.latest', 'INFERRED'),
  ('CALLS', 'shop.store.sign_up', 'shop.store.save', 'INFERRED'),
  ('CALLS', 'svc.Server.Run', 'svc.Server.log', 'INFERRED'),
  ('CALLS', 'ui.app.Circle.area', 'ui.app.Circle.square', 'INFERRED'),
  ('CALLS', 'ui.app.Circle.square', 'ui.helper.helper', 'INFERRED'),
  ('CALLS', 'ui.app.draw', 'ui.app.Circle.area', 'INFERRED'),
  ('CALLS', 'web.Account.name', 'web.Account.format', 'INFERRED'),
  ('CONTAINS', 'orders', 'orders.id', 'EXTRACTED'),
  ('CONTAINS', 'orders', 'orders.total', 'EXTRACTED'),
  ('CONTAINS', 'orders', 'orders.user_id', 'EXTRACTED'),
  ('CONTAINS', 'shop.broken', 'shop.broken.after', 'EXTRACTED'),
  ('CONTAINS', 'shop.broken', 'shop.broken.works', 'EXTRACTED'),
  ('CONTAINS', 'shop.models', 'shop.models.Base', 'EXTRACTED'),
  ('CONTAINS', 'shop.models', 'shop.models.User', 'EXTRACTED'),
  ('CONTAINS', 'shop.models', 'shop.models.split_address', 'EXTRACTED'),
  ('CONTAINS', 'shop.models.User', 'shop.models.User.domain', 'EXTRACTED'),
  ('CONTAINS', 'shop.store', 'shop.store.latest', 'EXTRACTED'),
  ('CONTAINS', 'shop.store', 'shop.store.save', 'EXTRACTED'),
  ('CONTAINS', 'shop.store', 'shop.store.sign_up', 'EXTRACTED'),
  ('CONTAINS', 'svc.Server', 'svc.Server.Run', 'EXTRACTED'),
  ('CONTAINS', 'svc.Server', 'svc.Server.log', 'EXTRACTED'),
  ('CONTAINS', 'svc.server', 'svc.New', 'EXTRACTED'),
  ('CONTAINS', 'svc.server', 'svc.Runner', 'EXTRACTED'),
  ('CONTAINS', 'svc.server', 'svc.Server', 'EXTRACTED'),
  ('CONTAINS', 'ui.app', 'ui.app.Base', 'EXTRACTED'),
  ('CONTAINS', 'ui.app', 'ui.app.Circle', 'EXTRACTED'),
  ('CONTAINS', 'ui.app', 'ui.app.Shape', 'EXTRACTED'),
  ('CONTAINS', 'ui.app', 'ui.app.draw', 'EXTRACTED'),
  ('CONTAINS', 'ui.app.Circle', 'ui.app.Circle.area', 'EXTRACTED'),
  ('CONTAINS', 'ui.app.Circle', 'ui.app.Circle.square', 'EXTRACTED'),
  ('CONTAINS', 'ui.helper', 'ui.helper.helper', 'EXTRACTED'),
  ('CONTAINS', 'users', 'users.email', 'EXTRACTED'),
  ('CONTAINS', 'users', 'users.id', 'EXTRACTED'),
  ('CONTAINS', 'web.Account', 'web.Account', 'EXTRACTED'),
  ('CONTAINS', 'web.Account', 'web.Account.format', 'EXTRACTED'),
  ('CONTAINS', 'web.Account', 'web.Account.name', 'EXTRACTED'),
  ('CONTAINS', 'web.Account', 'web.Base', 'EXTRACTED'),
  ('CONTAINS', 'web.Account', 'web.Named', 'EXTRACTED'),
  ('CONTAINS', 'web.Named', 'web.Named.name', 'EXTRACTED'),
  ('DOCUMENTS', 'shop/models.py::rationale@15', 'shop.models.User.domain', 'EXTRACTED'),
  ('IMPORTS', 'shop.models', 'sqlalchemy', 'EXTRACTED'),
  ('IMPORTS', 'shop.store', 'shop', 'EXTRACTED'),
  ('IMPORTS', 'svc.server', 'fmt', 'EXTRACTED'),
  ('IMPORTS', 'ui.app', 'ui.helper', 'EXTRACTED'),
  ('IMPORTS', 'web.Account', 'java.util.List', 'EXTRACTED'),
  ('IMPORTS', 'web.Account', 'web.Entity', 'EXTRACTED'),
  ('INHERITS', 'shop.models.User', 'shop.models.Base', 'EXTRACTED'),
  ('INHERITS', 'ui.app.Circle', 'ui.app.Base', 'EXTRACTED'),
  ('INHERITS', 'ui.app.Circle', 'ui.app.Shape', 'EXTRACTED'),
  ('INHERITS', 'web.Account', 'web.Base', 'EXTRACTED'),
  ('INHERITS', 'web.Account', 'web.Named', 'EXTRACTED'),
  ('JOINS', 'users', 'orders', 'INFERRED'),
  ('MAPS_TO', 'shop.models.User', 'users', 'EXTRACTED'),
  ('MAPS_TO', 'web.Account', 'users', 'EXTRACTED'),
  ('QUERIES', 'shop.models.User.domain', 'users.email', 'INFERRED'),
  ('QUERIES', 'shop.store.latest', 'orders', 'INFERRED'),
  ('QUERIES', 'shop.store.latest', 'orders.user_id', 'INFERRED'),
  ('QUERIES', 'shop.store.latest', 'users', 'INFERRED'),
  ('QUERIES', 'shop.store.latest', 'users.email', 'INFERRED'),
  ('QUERIES', 'shop.store.latest', 'users.id', 'INFERRED'),
  ('QUERIES', 'shop.store.save', 'users', 'INFERRED'),
  ('REFERENCES', 'orders.user_id', 'users', 'EXTRACTED')"""

EXTERNALS = """
  ('ext::fmt'),
  ('ext::java.util.List'),
  ('ext::shop'),
  ('ext::sqlalchemy'),
  ('ext::web.Entity')"""


def files(spark: SparkSession) -> DataFrame:
    """(path, lang, ord, sha, content), as sources.files.scan gives it."""
    rows = [(p, S.LANGUAGES[f".{p.rsplit('.', 1)[1]}"], S.SUFFIXES.index(f".{p.rsplit('.', 1)[1]}") + 1, t) for p, t in FILES.items()]
    df = spark.createDataFrame(rows, "path string, lang string, ord bigint, text string")
    return df.select("path", "lang", "ord", content_sha("text").alias("sha"), F.encode("text", "UTF-8").alias("content"))
