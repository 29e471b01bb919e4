"""Queries on the `nodes` relation: ancestry by intervals, text, links, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attribute(name: str, ns: str | None = None):
    """Value of an attribute of `attrs`, null if there is none."""
    own = lambda a: (a["name"] == name) & a["ns"].eqNullSafe(F.lit(ns))
    return F.try_element_at(F.filter("attrs", own), F.lit(1))["value"]


def elements(tree: DataFrame, *names: str) -> DataFrame:
    return tree.filter((F.col("kind") == "element") & F.col("name").isin(*names))


def descendants(tree: DataFrame, roots: DataFrame, columns=("name", "value", "kind", "enter_seq", "attrs")) -> DataFrame:
    """Pairs of a root (doc_id, root_id, enter_seq, exit_seq) and each node within: one join by document and interval."""
    r = roots.select("doc_id", F.col("node_id").alias("root_id"), F.col("enter_seq").alias("root_enter"), F.col("exit_seq").alias("root_exit"))
    inside = (F.col("enter_seq") > F.col("root_enter")) & (F.col("exit_seq") < F.col("root_exit"))
    return tree.join(r, "doc_id").filter(inside).select("doc_id", "root_id", "node_id", *columns)


def text_content(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, root_id, text: the texts within each root in document order; empty if it has none."""
    texts = descendants(tree.filter(F.col("kind") == "text"), roots, ("value", "enter_seq"))
    joined = texts.groupBy("doc_id", "root_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("enter_seq", "value"))), lambda x: x["value"]), "").alias("text"))
    return roots.select("doc_id", F.col("node_id").alias("root_id")).join(joined, ["doc_id", "root_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def children(tree: DataFrame, parent: str, child: str) -> DataFrame:
    """Child elements with their parents' ids."""
    up = elements(tree, parent).select("doc_id", F.col("node_id").alias("parent_id"))
    return elements(tree, child).join(up, ["doc_id", "parent_id"], "left_semi")


def links(tree: DataFrame) -> DataFrame:
    """doc_id, node_id, href of every `a` with one."""
    return elements(tree, "a").select("doc_id", "node_id", attribute("href").alias("href")).filter("href is not null")


def nested(tree: DataFrame, name: str) -> DataFrame:
    """Elements within another element of their name, by one window a document and no join."""
    order = Window.partitionBy("doc_id").orderBy("enter_seq").rowsBetween(Window.unboundedPreceding, -1)
    return elements(tree, name).withColumn("open_until", F.max("exit_seq").over(order)).filter("exit_seq < open_until")


def main_tree(tree: DataFrame) -> DataFrame:
    """The root element and what is in it: the view of a tree without doctype and outer comments."""
    root = tree.filter((F.col("kind") == "element") & (F.col("depth") == 1)).select("doc_id", F.col("enter_seq").alias("a"), F.col("exit_seq").alias("b"))
    return tree.join(root, "doc_id").filter((F.col("enter_seq") >= F.col("a")) & (F.col("exit_seq") <= F.col("b"))).drop("a", "b")


def flavour(tree: DataFrame, kind: str) -> DataFrame:
    """The view of a tree that a tree library gives: "etree" the root element, "dom" all, "lxml" all with XML-safe names."""
    from tagloom.operators.serialize import coerce_names

    views = {"etree": main_tree, "dom": lambda t: t, "lxml": coerce_names}
    if kind.lower() not in views:
        raise ValueError(f"unknown tree flavour: {kind}")
    return views[kind.lower()](tree)


# -- the same within one document: columns over the `nodes` array of a parsed document, no join and no exchange
#
# The array is in document order, a node's id is its index, and each node takes two numbers of the
# sequence; so a node's parent is one look-up and what is in it is one slice.


def array_elements(nodes: Column, *names: str) -> Column:
    """The elements of these names."""
    return F.filter(nodes, lambda n: (n["kind"] == "element") & n["name"].isin(*names))


def array_descendants(nodes: Column, node: Column) -> Column:
    """The nodes in a node of the array."""
    return F.slice(nodes, node["node_id"] + 2, F.shiftright(node["exit_seq"] - node["enter_seq"] - 1, 1))


def array_parent(nodes: Column, node: Column) -> Column:
    """The parent of a node of the array, null for the root."""
    return F.get(nodes, node["parent_id"])


def array_text(nodes: Column, node: Column) -> Column:
    """The texts in a node, in document order; empty if it has none."""
    texts = F.filter(array_descendants(nodes, node), lambda n: n["kind"] == "text")
    return F.array_join(F.transform(texts, lambda n: n["value"]), "")
