"""Relational operators over project relations: diff, rules, graph closure, reports."""
