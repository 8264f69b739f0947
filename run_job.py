"""Script form of ``python -m triplewright.job`` for spark-submit."""

from triplewright.job import main

if __name__ == "__main__":
    main()
