"""Column functions: pure expressions over text, boxes, actions and JSON."""
