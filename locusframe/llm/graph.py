"""Connected components of links kept in tables."""

from locusframe.graph import components as components
