"""The only package that touches the JVM parser."""
