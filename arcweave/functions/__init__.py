"""arcweave subpackage."""
