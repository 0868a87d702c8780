"""Operators of lodeline: frames in, frames out; modules hold their QUERIES and ORACLE."""
