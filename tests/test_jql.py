from hypothesis import given
from hypothesis import strategies as st

from lodegraph.functions import jql as J
from lodegraph.functions import scalars as X


def test_clauses():
    q = J.parse_jql('related:"BaseHandler" dir:incoming has_rel:inherits')
    assert q.first("related") == "BaseHandler" and q.direction == "in" and q.first("has_rel") == "inherits"
    q = J.parse_jql("type:Class connections:>10 limit:5")
    assert q.types == ["class"] and q.connections[0].op == ">" and q.limit == 5
    assert J.parse_jql("type:class OR type:interface").types == ["class", "interface"]
    assert J.parse_jql("colour:red").is_empty
    assert J.parse_jql("limit:900").limit == 500 and J.parse_jql("limit:0").limit == 1 and J.parse_jql("").limit == 20
    assert J.parse_jql("connections:!=3").connections[0].op == "="
    assert J.is_jql("find type:class") and not J.is_jql("http: //x")


@given(st.text(max_size=80))
def test_any_text_parses(text):
    q = J.parse_jql(text)
    assert 1 <= q.limit <= 500
    J.parse_question(text).to_jql()


def test_questions():
    assert J.parse_question("classes that extend BaseHandler").to_jql() == "type:class related:BaseHandler has_rel:inheritance"
    assert J.parse_question("functions in the auth module").to_jql() == "type:function file:auth/*"
    assert J.parse_question("What classes handle user authentication?").to_jql() == 'type:class text:"handle user authentication"'
    assert J.parse_question("").to_jql() == ""


def test_clauses_of_the_scanner():
    q = J.parse_jql("type:class or type:interface")
    assert q.any_of and q.types == ["class", "interface"]
    assert J.parse_jql("layer:CORE_TYPE").layer == "core_type"
    assert J.parse_jql("has_rel:INHERITS has_rel:calls").relations == ["inherits", "calls"]
    assert J.parse_jql('text:"two words" name:x').text == "two words"
    assert J.parse_jql('related:"never closed').first("related") == "never closed"
    assert J.parse_jql("connections:>=10").connections[0].op == ">=" and J.parse_jql("connections:>abc").connections[0].value == "abc"
    assert J.parse_jql("type:").is_empty and J.parse_jql("connections:<>3").is_empty
    assert J.parse_jql("file:src/a:b").first("file") == "src/a:b"


def test_question_phrases():
    q = J.parse_question("functions in src/auth")
    assert (q.type, q.path, q.words) == ("function", "src/auth", [])
    q = J.parse_question("which methods call the SessionStore in package billing")
    assert (q.type, q.relation, q.related, q.path) == ("method", "calls", "SessionStore", "billing")
    assert J.parse_question("overview of the payment flow").intent == "architecture"
    assert J.parse_question("how is authentication done").intent == "security"
    assert not J.parse_question("payment processing logic").has_filters
    assert J.parse_question("payment processing logic").words == ["payment", "processing", "logic"]
    assert J.parse_question("functions in payment processing").words == ["payment", "processing"]
    assert J.parse_question("   ").to_jql() == ""


def test_keywords():
    assert J.keywords("how does parseHTTPRequest work") == ["parsehttprequest", "parse", "http", "request"]
    assert J.keywords("authService", parts=False) == ["authservice"]
    assert J.keywords("a db an db") == ["db"] and J.keywords("") == []


def test_glob():
    import re

    assert re.fullmatch(X.glob_regex("src/*.py"), "src/a/b.py") and not re.fullmatch(X.glob_regex("src/*.py"), "lib/a.py")
    assert re.fullmatch(X.glob_regex("[!a]?c"), "bxc") and not re.fullmatch(X.glob_regex("[!a]?c"), "axc")
