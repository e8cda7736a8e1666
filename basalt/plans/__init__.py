"""The small SQL dialect: text to checked query to one lazy DataFrame."""
