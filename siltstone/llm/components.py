"""Connected components: the library's, under the name that the operators use."""

from siltstone.operators.components import components

__all__ = ["components"]
