"""Operators that repair, split, pair, pack and check texts for training data; nothing outside this subpackage imports it."""
