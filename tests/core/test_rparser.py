"""Extraction of definitions and calls."""

import pytest

from loomgraph.sources import rparser as r

SOURCE = """
#' Cleans a table.
#' @param d data
clean <- function(d, strict = TRUE) {
  if (strict) d <- d[complete.cases(d), ]
  else d
  out <- dplyr::mutate(d, new = old * 2, width)
  helper <- function(z) sqrt(z)
  helper(out$x) |> summarise(.data$total, kept)
}

f2 = \\(x, ...) x %||% log(abs(x))
5 -> five
load_all -> alias; other <- function() NULL
setGeneric("speak", function(x) standardGeneric("speak"))
Dog <- R6Class("Dog", public = list(bark = function(n) print(n), name = NULL), private = list(hide = function() shadow()))
txt <- r"(a "quoted" )" ; for (i in 1:3) { repeat break }
"""


def test_definitions():
    rows = {x["name"]: x for x in r.extract("proj/R/tools.R", SOURCE)}
    assert list(rows) == ["clean", "f2", "other", "speak", "Dog$bark", "Dog$hide"]
    c = rows["clean"]
    assert c["id"] == "R/tools::clean" and c["signature"] == "clean(d, strict)" and (c["line_start"], c["line_end"]) == (4, 10)
    assert c["roxygen_text"] == "#' Cleans a table.\n#' @param d data" and c["complexity"] == 2
    assert c["calls_list"] == ["complete.cases", "dplyr::mutate", "sqrt", "summarise"]
    assert rows["f2"]["signature"] == "f2(x, ...)" and rows["f2"]["calls_list"] == ["%||%", "abs", "log"]
    assert rows["Dog$hide"]["calls_list"] == ["shadow"] and rows["speak"]["signature"] == "speak"


@pytest.mark.parametrize("text", ["f <- function(x {", "x <- 'open", "}", "a b", "f(,))"])
def test_unparsable_files_have_no_rows(text):
    assert r.extract("d/x.R", text) == [] and r.symbols_called(text) == []


@pytest.mark.parametrize("text", ["", "# only", "if (a) b else c", "x[[1]][2]$y@z", "-2^2:3", "y ~ x + z", "f(a = , b)", "function(x) x", "a %in%\n b", "f(\n a,\n b\n)", "x$`odd name`(1)", "!a && b || c", "`my fun` <- function() 1"])
def test_parses(text):
    r.parse(text)


def test_precedence():
    (n,) = r.parse("a <- b + c * d ^ e")
    assert n.head.text == "<-" and n.args[1][1].head.text == "+" and n.args[1][1].args[1][1].head.text == "*"
    (n,) = r.parse("-a:b")
    assert n.head.text == ":"


def test_calls():
    calls = lambda t: r.find_calls(r.parse(t)[0])
    assert calls("sqrt(log(abs(x)))") == ["abs", "log", "sqrt"]
    assert calls("fs::path_abs(x)") == ["fs::path_abs"]
    assert calls("vapply(x, f, 1)") == ["vapply"]
    assert calls("mutate(d, filter(x))") == ["filter", "mutate"]
    assert calls("f({{ col }}, sym(name))") == ["f", "sym"]
    assert calls("x + 1") == []
