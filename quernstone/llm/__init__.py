"""Operators that prepare text corpora for training. Nothing else in quernstone imports this subpackage."""
