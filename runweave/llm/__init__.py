"""Operators for preparing training data. Nothing else in runweave imports this subpackage."""
