"""The table model, its declarations and the token language; all of it compiles to one lazy DataFrame."""
