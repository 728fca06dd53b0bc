def page(n):
    return [{"id": n * 10 + i, "text": f"t{n}.{i}"} for i in range(3)]
